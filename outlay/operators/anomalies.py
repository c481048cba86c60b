"""Daily spend anomalies against a trailing baseline."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.dates import day_lit
from outlay.functions.money import dmoney, ratio, rounded
from outlay.operators.billing import service_name, line_net, project_or_account
from outlay.sources.billing import regular_only, usage_day

KEYS = ["project_id", "service"]


def daily_cost(lines: DataFrame) -> DataFrame:
    """Net cost per usage day, project and service."""
    return (
        lines.select(
            usage_day().alias("usage_date"), project_or_account().alias("project_id"), service_name().alias("service"), line_net().alias("net")
        )
        .groupBy("usage_date", *KEYS)
        .agg(F.sum("net").alias("net_cost"))
    )


def densify_daily(daily: DataFrame, keys: list[str], first: Column, last: Column, value: str = "net_cost") -> DataFrame:
    """One row per key and day from ``first`` to ``last``, 0 where the key has no row.

    ``daily`` has one row per key and day, inside the range.  Every row also emits the empty days
    up to the next row of its key, and the first row those before it.  The daily rows are used
    once and shuffled once by key, and a window by key over the result needs no other shuffle; a
    cross join of a calendar with the distinct keys would aggregate the input a second time.
    """
    order = Window.partitionBy(*keys).orderBy("usage_date")
    return (
        daily.select(
            *keys,
            F.col("usage_date").alias("own_day"),
            F.col(value).alias("own_value"),
            F.when(F.lag("usage_date").over(order).isNull(), first).otherwise(F.col("usage_date")).alias("from_day"),
            F.coalesce(F.date_sub(F.lead("usage_date").over(order), 1), last).alias("to_day"),
        )
        .select("*", F.explode(F.sequence("from_day", "to_day")).alias("usage_date"))
        .select(
            "usage_date",
            *keys,
            F.when(F.col("usage_date") == F.col("own_day"), F.col("own_value")).otherwise(F.lit(0)).cast("decimal(38,10)").alias(value),
        )
    )


def score(series: DataFrame, baseline_days: int = 30) -> DataFrame:
    """Trailing mean, sample deviation and count over the days before each day."""
    window = (
        Window.partitionBy(*KEYS).orderBy(F.unix_date("usage_date")).rangeBetween(-baseline_days, -1)
    )
    x = F.col("net_cost").cast("double")
    return series.select(
        "*",
        F.avg(x).over(window).alias("baseline_mean"),
        F.stddev_samp(x).over(window).alias("baseline_stddev"),
        F.count("net_cost").over(window).alias("baseline_n"),
    )


def verdicts(scored: DataFrame, z_threshold: float, min_abs_delta: float, min_n: int, flag_zero_variance: bool) -> DataFrame:
    """The scored days that leave their baseline, with z-score and direction."""
    delta = F.col("net_cost").cast("double") - F.col("baseline_mean")
    z = ratio(delta, F.nullif(F.col("baseline_stddev"), F.lit(0.0)))
    unusual = F.abs(z) >= z_threshold
    if flag_zero_variance:
        unusual = unusual | (F.col("baseline_stddev") == 0)
    return scored.filter((F.col("baseline_n") >= min_n) & unusual & (F.abs(delta) >= min_abs_delta)).select(
        "usage_date",
        *KEYS,
        dmoney(F.col("net_cost")).alias("net_cost"),
        rounded(F.col("baseline_mean")).alias("baseline_mean"),
        rounded(F.col("baseline_stddev")).alias("baseline_stddev"),
        rounded(z).alias("z_score"),
        rounded(delta).alias("abs_delta"),
        F.when(delta > 0, "spike").otherwise("drop").alias("direction"),
    )


def daily_anomalies(
    lines: DataFrame,
    as_of: dt.date,
    baseline_days: int = 30,
    settle_days: int = 2,
    z_threshold: float = 3.0,
    min_abs_delta: float = 50.0,
    min_n: int = 14,
    score_since: dt.date | None = None,
    flag_zero_variance: bool = False,
) -> DataFrame:
    """Days whose cost leaves the baseline by ``z_threshold`` deviations and ``min_abs_delta``.

    Only the day ``as_of - settle_days`` is scored.  With ``score_since`` every day from that date
    on is scored (back-fill), each against the whole baseline before it.  A constant baseline has no z-score and never alerts unless
    ``flag_zero_variance`` is set.
    """
    target = as_of - dt.timedelta(days=settle_days)
    first = (score_since or target) - dt.timedelta(days=baseline_days + 1)
    # Lines of a day arrive on that day at the earliest; the days before allow for clocks.
    reach = first - dt.timedelta(days=4)
    base = regular_only(lines).filter(F.col("ingest_date").between(day_lit(reach), day_lit(as_of)) & (usage_day() <= day_lit(target)))
    daily = daily_cost(base.filter(usage_day() >= day_lit(first)))
    scored = score(densify_daily(daily, KEYS, day_lit(first), day_lit(target)), baseline_days)
    scored = scored.filter(F.col("usage_date") >= day_lit(score_since or target))
    return verdicts(scored, z_threshold, min_abs_delta, min_n, flag_zero_variance)
