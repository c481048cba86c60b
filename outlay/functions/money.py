"""Money, rounding and number formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Export amounts carry tiny fractions per line; nothing is rounded before it is summed.
MONEY = "decimal(28,10)"
# Of a whole array of amounts, in every step.
SUM = "decimal(30,10)"
ZERO = f"cast(0 as {MONEY})"


def rounded(x: Column, digits: int = 2) -> Column:
    """Round a double through DECIMAL, so that ties behave the same on every engine."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def dmoney(x: Column, digits: int = 2) -> Column:
    """Round an exact decimal and hand it out as a double."""
    return F.round(x, digits).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """NULL when the divisor is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# Lines nearly always carry very few credits.
SHORT = 3


def _zero() -> Column:
    return F.expr(ZERO)


def _fold(amounts: Column, at: Callable[[int], Column], length: Column | None = None) -> Column:
    """Sum of an array of decimals without its NULLs; NULL for a NULL array, 0 for an empty one.

    Higher-order functions are interpreted row by row.  Up to ``SHORT`` entries are added by plain
    expressions over ``at(i)``, which compile; longer arrays go through ``aggregate``.  Both are exact,
    so the result does not depend on the length.
    """
    short = sum((F.coalesce(at(i), _zero()) for i in range(1, SHORT)), F.coalesce(at(0), _zero()))
    every = F.aggregate(amounts, _zero().cast(SUM), lambda acc, x: (acc + F.coalesce(x, _zero())).cast(SUM))
    length = F.size(amounts) if length is None else length
    return F.when(length.between(0, SHORT), short.cast(SUM)).otherwise(every)


def fold_credits(credits: Column) -> Column:
    """Sum of all credit amounts on the line; reads only the amounts of the credits."""
    amounts = credits["amount"]
    return _fold(amounts, lambda i: F.get(amounts, F.lit(i)))


def net_cost(cost: Column, credits: Column) -> Column:
    return cost + F.coalesce(fold_credits(credits), _zero())


def credits_of_type(credits: Column, *types: str) -> Column:
    """Sum of the credits of the given types; 0 when there is none."""
    kinds, amounts = credits["type"], credits["amount"]

    def at(i: int) -> Column:
        return F.when(F.get(kinds, F.lit(i)).isin(*types), F.get(amounts, F.lit(i)))

    chosen = F.zip_with(kinds, amounts, lambda k, x: F.when(k.isin(*types), x))
    return F.coalesce(_fold(chosen, at, length=F.size(amounts)), _zero())


def fmt_money(x: Column, currency: str = "USD") -> Column:
    return F.concat(F.format_number(x, 2), F.lit(f" {currency}"))


def fmt_percent(x: Column, digits: int = 0) -> Column:
    return F.concat(fixed_point(x.cast("double") * 100, digits), F.lit("%"))


def fixed_point(x: Column, digits: int) -> Column:
    """Fixed-point text without digit grouping."""
    return F.translate(F.format_number(x, digits), ",", "")


def fmt_bytes(n: Column) -> Column:
    """Binary units, one decimal; PiB is the last unit."""
    value = n.cast("double")
    out = None
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    for power, unit in enumerate(units):
        text = F.concat(F.format_number(value / float(1024**power), 1), F.lit(f" {unit}"))
        cond = value < float(1024 ** (power + 1))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.concat(F.format_number(value / float(1024**5), 1), F.lit(" PiB")))


def round_up(x: Column, step: int) -> Column:
    """Next multiple of ``step``; one step for zero and below."""
    return F.when(x > 0, F.ceil(x / step) * step).otherwise(F.lit(step)).cast("int")


def price(prices: dict, section: str, key: str) -> Column:
    return F.lit(float(prices[section][key]))
