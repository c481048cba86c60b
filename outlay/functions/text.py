"""Regular-expression classification and tokens of resource names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay import fixed


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern occurs in the text."""
    (first, name), *rest = rules
    out = F.when(text.rlike(first), F.lit(name))
    for pattern, name in rest:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default))


def egress_class(sku: Column) -> Column:
    return classify(sku, fixed.EGRESS_CLASSES, fixed.EGRESS_OTHER)


def lookup_text(code: Column, texts: dict[str, str], default: str) -> Column:
    """CASE code -> text."""
    out = None
    for key, text in texts.items():
        cond = code == F.lit(key)
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out.otherwise(F.lit(default))


def first_token(text: Column, sep: str = "-", missing: str = "unknown") -> Column:
    return F.split_part(F.coalesce(text, F.lit(missing)), F.lit(sep), F.lit(1))


def workload_of_pod(pod: Column) -> Column:
    """Drop the last two dash-separated tokens of a pod name."""
    return F.regexp_replace(pod, r"(-[^-]*){1,2}$", "")


def machine_vcpus(machine_type: Column) -> Column:
    """Number after the last dash; 2 when there is no dash or no number."""
    number = F.substring_index(machine_type, "-", -1).try_cast("int")
    return F.when(machine_type.contains("-"), F.coalesce(number, F.lit(2))).otherwise(F.lit(2))


def looks_temporal(column: Column) -> Column:
    """Substring heuristic for date-like column names."""
    name = F.lower(column)
    hit = name.isin(*fixed.TEMPORAL_NAMES)
    for token in fixed.TEMPORAL_TOKENS:
        hit = hit | name.contains(token)
    return hit
