"""Dashboard scorecards, KPIs and commitment analytics on billing lines."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import calendar_days, day_lit, local_time, months_back
from outlay.functions.labels import label_value
from outlay.functions.money import MONEY, dmoney, fold_credits, ratio, rounded
from outlay.operators import billing as b
from outlay.sources.billing import billing_scan, billing_scan_months, regular_only, usage_day


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value).otherwise(_zero())), _zero())


def _since(lines: DataFrame, as_of: dt.date, first: dt.date) -> DataFrame:
    """Regular lines used from ``first`` to ``as_of``; ingestion can only be later than use."""
    return regular_only(lines).filter(
        (F.col("ingest_date") >= day_lit(first))
        & (F.col("ingest_date") <= day_lit(as_of))
        & usage_day().between(day_lit(first), day_lit(as_of))
    )


def overview(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Month-to-date cost, linear forecast, change against last month, and credits."""
    month_start, last_start = as_of.replace(day=1), months_back(as_of, 1)
    base = _since(lines, as_of, last_start).select(
        usage_day().alias("day"), b.line_net().alias("net"), F.coalesce(fold_credits(F.col("credits")), _zero()).alias("credit")
    )
    current = F.col("day") >= day_lit(month_start)
    sums = base.agg(
        _if(current, F.col("net")).alias("mtd"),
        _if(~current, F.col("net")).alias("last_month"),
        _if(current, F.col("credit")).alias("credits"),
    )
    days = calendar.monthrange(as_of.year, as_of.month)[1]
    forecast = F.col("mtd").cast("double") / as_of.day * days
    return sums.select(
        dmoney(F.col("mtd")).alias("mtd_net_cost"),
        rounded(forecast).alias("mtd_forecast"),
        dmoney(F.col("last_month")).alias("last_month_net_cost"),
        rounded(ratio(F.col("mtd") - F.col("last_month"), F.col("last_month")) * 100, 1).alias("mom_pct"),
        dmoney(F.col("credits")).alias("mtd_credits"),
    )


def cost_per_day(lines: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    base = billing_scan(lines, as_of, window_days)
    return (
        base.select(usage_day().alias("usage_date"), b.service_name().alias("service"), b.line_net().alias("net"))
        .groupBy("usage_date", "service")
        .agg(dmoney(F.sum("net")).alias("net_cost"))
    )


def showback_pivot(lines: DataFrame, as_of: dt.date, envs: tuple[str, ...] = ("dev", "uat", "prod", fixed.UNLABELLED)) -> DataFrame:
    """Team and cost centre against environment, one column per environment."""
    base = b.showback_lines(billing_scan_months(lines, as_of))
    pivoted = base.groupBy("team", "cost_center").pivot("env", list(envs)).agg(F.sum("net"))
    names = {e: "cost_" + e.strip("()") for e in envs}
    return pivoted.select("team", "cost_center", *[dmoney(F.coalesce(F.col(f"`{e}`"), _zero())).alias(n) for e, n in names.items()])


def top_projects(lines: DataFrame, as_of: dt.date, top: int = 10) -> DataFrame:
    base = b.showback_lines(billing_scan_months(lines, as_of))
    return (
        base.groupBy("project_id")
        .agg(F.sum("net").alias("net"))
        .orderBy(F.col("net").desc(), "project_id")
        .limit(top)
        .select("project_id", dmoney(F.col("net")).alias("net_cost"))
    )


def unlabelled_by_project(lines: DataFrame, as_of: dt.date) -> DataFrame:
    base = b.showback_lines(billing_scan_months(lines, as_of)).filter(F.col("team") == fixed.UNLABELLED)
    return base.groupBy("project_id").agg(dmoney(F.sum("net")).alias("unlabelled_cost"))


def unallocated_share(lines: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Share of each cluster's cost that no namespace asked for."""
    base = b.cluster_lines(billing_scan(lines, as_of, window_days))
    idle = F.col("namespace") == fixed.UNALLOCATED
    sums = base.groupBy("project_id", "cluster").agg(F.sum("net").alias("net"), _if(idle, F.col("net")).alias("idle"))
    return sums.select(
        "project_id",
        "cluster",
        dmoney(F.col("net")).alias("net_cost"),
        rounded(ratio(F.col("idle"), F.col("net")) * 100, 1).alias("unallocated_pct"),
    )


def commitment_trend(lines: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Commitment coverage and sustained-use credits per invoice month and region."""
    keys = ["invoice_month", "region"]
    marked = b.commitment_lines(billing_scan_months(lines, as_of, months))
    return b.commitment_sums(marked, keys).select(*keys, *b.commitment_columns())


def unlabelled_kpi(lines: DataFrame, as_of: dt.date, target_pct: float = fixed.UNLABELLED_TARGET_PCT) -> DataFrame:
    """Share of unlabelled spend per month against the target."""
    base = b.showback_lines(billing_scan_months(lines, as_of))
    sums = base.groupBy("invoice_month").agg(
        F.sum("net").alias("net"), _if(F.col("team") == fixed.UNLABELLED, F.col("net")).alias("unlabelled")
    )
    pct = ratio(F.col("unlabelled"), F.col("net")) * 100
    return sums.select(
        "invoice_month",
        dmoney(F.col("net")).alias("net_cost"),
        rounded(pct).alias("unlabelled_pct"),
        F.when(pct < target_pct, "ok").otherwise("above target").alias("status"),
    )


def unit_cost(lines: DataFrame, units: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Net cost per business unit and day, by app label; days without units have no unit cost."""
    daily = (
        billing_scan(lines, as_of, window_days)
        .select(label_value(F.col("labels"), "app").alias("app"), usage_day().alias("date"), b.line_net().alias("net"))
        .filter(F.col("app").isNotNull())
        .groupBy("app", "date")
        .agg(F.sum("net").alias("net"))
    )
    return daily.join(units, ["app", "date"], "inner").select(
        "app", "date", dmoney(F.col("net")).alias("net_cost"), "units", rounded(ratio(F.col("net"), F.col("units")), 4).alias("cost_per_unit")
    )


def team_cost(lines: DataFrame, mapping: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Cluster cost by the team that owns the namespace.

    Cost is summed by namespace before the join, so the join is small on both sides; Spark
    broadcasts the mapping when its measured size allows.
    """
    spend = b.cluster_lines(billing_scan(lines, as_of, window_days)).groupBy("namespace").agg(F.sum("net").alias("net"))
    return (
        spend.join(mapping, "namespace", "left")
        .groupBy(F.coalesce("team", F.lit("(unmapped)")).alias("team"))
        .agg(dmoney(F.sum("net")).alias("net_cost"))
    )


def commitment_size(lines: DataFrame, as_of: dt.date, window_days: int = 90, present: float = 0.95) -> DataFrame:
    """Usage present in ``present`` of all hours, per machine family and region.

    Hours without usage count as 0.  The hours of a family and region are at most 24 per day, so
    its percentile fits one task however many lines there are.
    """
    keys = ["machine_family", "region"]
    hours = (window_days + 1) * 24
    hourly = (
        b.commitment_lines(billing_scan(lines, as_of, window_days))
        .filter("is_eligible")
        .groupBy(*keys, F.date_trunc("HOUR", "usage_start_time").alias("hour"))
        .agg(F.sum("usage_amount").alias("amount"))
    )
    stats = hourly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours_with_usage"),
        F.sort_array(F.collect_list("amount")).alias("amounts"),
        F.sum("amount").alias("total"),
    )
    # Interpolated percentile over the dense hours: the first (hours - used) values are 0.
    position = F.lit((1 - present) * (hours - 1))
    low = F.floor(position)
    zeros = F.lit(hours) - F.col("hours_with_usage")

    def nth(i: Column) -> Column:
        return F.when(i < zeros, F.lit(0.0)).otherwise(F.get("amounts", (i - zeros).cast("int")))

    trough = nth(low) + (nth(low + 1) - nth(low)) * (position - low)
    return stats.select(
        *keys,
        F.lit(hours).alias("hours"),
        "hours_with_usage",
        rounded(F.col("total") / hours, 4).alias("mean_usage"),
        rounded(trough, 4).alias("commit_usage"),
    )


def commitment_health(coverage: DataFrame) -> DataFrame:
    """Utilisation of the fee and the health bands of coverage."""
    cov, fee = F.col("cud_coverage_pct"), F.col("commitment_fees")
    utilisation = ratio(F.least(F.col("cud_credit_applied"), fee), fee) * 100
    return coverage.select(
        *[c for c in ("region", "machine_family") if c in coverage.columns],
        cov,
        rounded(utilisation, 1).alias("utilisation_pct"),
        F.when(cov > 90, "inflexible").when(cov > 80, "high").when(cov >= 60, "healthy").when(cov.isNotNull(), "low").otherwise("no usage").alias("coverage_band"),
        F.when(utilisation > 95, "healthy").when(utilisation.isNotNull(), "idle").otherwise("no commitment").alias("utilisation_band"),
    )


def arrival_lag(lines: DataFrame, settle_days: int = 3, as_of: dt.date | None = None, window_days: int = 90) -> DataFrame:
    """Lines and cost by days between use and export, with what arrives after the horizon.

    With ``as_of`` only the partitions ingested in the ``window_days`` up to it are read.
    """
    if as_of is not None:
        lines = lines.filter(F.col("ingest_date").between(day_lit(as_of - dt.timedelta(days=window_days)), day_lit(as_of)))
    lag = calendar_days(F.col("usage_start_time"), F.col("export_time"))
    sums = lines.groupBy(lag.alias("lag_days")).agg(F.count(F.lit(1)).alias("lines"), F.sum("cost").alias("cost"))
    return sums.select("lag_days", "lines", dmoney(F.col("cost")).alias("cost"), (F.col("lag_days") > settle_days).alias("beyond_horizon"))


def off_hours_share(
    lines: DataFrame, as_of: dt.date, window_days: int = 30, tz: str = "Asia/Kolkata", start_hour: int = 8, end_hour: int = 20
) -> DataFrame:
    """Share of cost outside Monday to Friday, 08 to 20 o'clock local time, per environment."""
    local = local_time(F.col("usage_start_time"), tz)
    base = billing_scan(lines, as_of, window_days).select(
        b.label_chain("env").alias("env"), local.alias("local"), b.line_net().alias("net")
    )
    hour = F.hour("local")
    working = (F.weekday("local") < 5) & (hour >= start_hour) & (hour < end_hour)
    sums = base.groupBy("env").agg(F.sum("net").alias("net"), _if(~working, F.col("net")).alias("off"))
    return sums.select(
        "env", dmoney(F.col("net")).alias("net_cost"), dmoney(F.col("off")).alias("off_hours_cost"), rounded(ratio(F.col("off"), F.col("net")) * 100, 1).alias("off_hours_pct")
    )
