"""Budget thresholds: actual and forecast spend against a monthly amount."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import day_lit
from outlay.functions.money import dmoney, rounded
from outlay.operators.billing import line_net, project_or_account
from outlay.sources.billing import regular_only, usage_day


def month_to_date(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Net cost of the month so far per project, with its linear forecast."""
    first = as_of.replace(day=1)
    days = calendar.monthrange(as_of.year, as_of.month)[1]
    return (
        regular_only(lines)
        .filter(
            (F.col("ingest_date") >= day_lit(first))
            & (F.col("ingest_date") <= day_lit(as_of))
            & usage_day().between(day_lit(first), day_lit(as_of))
        )
        .select(project_or_account().alias("project_id"), line_net().alias("net"))
        .groupBy("project_id")
        .agg(F.sum("net").alias("actual"))
        .select(
            F.lit(first.strftime("%Y%m")).alias("month"),
            "project_id",
            F.col("actual"),
            (F.col("actual").cast("double") / as_of.day * days).alias("forecast"),
        )
    )


def _thresholds(actual: tuple[float, ...], forecast: tuple[float, ...]) -> Column:
    return F.array(
        *[F.struct(F.lit("actual").alias("basis"), F.lit(t).alias("threshold")) for t in actual],
        *[F.struct(F.lit("forecast").alias("basis"), F.lit(t).alias("threshold")) for t in forecast],
    )


def budget_alerts(
    spend: DataFrame,
    budget: float,
    fired: DataFrame | None = None,
    actual: tuple[float, ...] = fixed.BUDGET_THRESHOLDS,
    forecast: tuple[float, ...] = fixed.FORECAST_THRESHOLDS,
) -> DataFrame:
    """Thresholds crossed per project and month; those in ``fired`` do not fire again."""
    crossed = spend.select("month", "project_id", "actual", "forecast", F.inline(_thresholds(actual, forecast))).filter(
        F.when(F.col("basis") == "actual", F.col("actual").cast("double")).otherwise(F.col("forecast"))
        >= F.col("threshold") * budget
    )
    if fired is not None:
        crossed = crossed.join(fired, ["month", "project_id", "basis", "threshold"], "left_anti")
    return crossed.select(
        "month",
        "project_id",
        "basis",
        "threshold",
        dmoney(F.col("actual")).alias("actual_cost"),
        rounded(F.col("forecast")).alias("forecast_cost"),
    )
