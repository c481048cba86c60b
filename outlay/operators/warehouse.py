"""Query-log rollup, warehouse table layout and slot break-even."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import ts_lit
from outlay.functions.labels import label_value
from outlay.functions.money import fixed_point, fmt_bytes, fmt_percent, price, rounded
from outlay.functions.template import fill
from outlay.functions.text import looks_temporal
from outlay.operators.findings import details_json, finding, union_all

TIB = float(fixed.TIB)
GB = float(fixed.GB)
# Whitespace of the log's own regular-expression dialect, which has no vertical tab.
BLANKS = r"[\t\n\f\r ]+"


def window_start(now: dt.datetime, window_days: int) -> Column:
    return ts_lit(now - dt.timedelta(days=window_days))


def query_rollup(log: DataFrame, now: dt.datetime, window_days: int = 30, top: int | None = 200) -> DataFrame:
    """Finished queries by normalised text and team, the largest ``top`` by bytes billed.

    User and text come from the job with the smallest id of the group.  Only ids and numbers go
    through the shuffle; the texts of the kept groups are fetched afterwards by their job id.
    """
    jobs = log.filter(
        (F.col("creation_time") >= window_start(now, window_days))
        & (F.col("job_type") == "QUERY")
        & (F.col("state") == "DONE")
        & F.col("error_result").isNull()
    )
    rolled = (
        jobs.select(
            F.md5(F.regexp_replace("query", BLANKS, " ").cast("binary")).alias("query_hash"),
            label_value(F.col("labels"), "team").alias("label_team"),
            "job_id",
            "total_bytes_billed",
            "total_slot_ms",
            F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).alias("seconds"),
        )
        .groupBy("query_hash", "label_team")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.sum("total_bytes_billed").alias("total_bytes_billed"),
            F.sum("total_slot_ms").alias("total_slot_ms"),
            F.avg("seconds").alias("avg_duration_s"),
            F.min("job_id").alias("job_id"),
        )
    )
    texts = jobs.select("job_id", "user_email", F.col("query").alias("sample_sql"))
    if top is not None:
        rolled = rolled.orderBy(F.col("total_bytes_billed").desc(), "query_hash", "label_team").limit(top)
    return texts.join(rolled, "job_id", "inner").drop("job_id")


def on_demand_cost(bytes_billed: Column, prices: dict) -> Column:
    return bytes_billed.cast("double") / TIB * price(prices, "bigquery", "on_demand_per_tib")


def _monthly(cost: Column, window_days: int) -> Column:
    return cost * 30.0 / window_days


def _graded(monthly: Column) -> Column:
    return F.when(monthly > 500, "high").when(monthly > 50, "medium").otherwise("low")


def expensive_queries(jobs: DataFrame, prices: dict, window_days: int = 30, top_n: int = 5) -> DataFrame:
    """The ``top_n`` queries by bytes billed, with hints."""
    top = jobs.orderBy(F.col("total_bytes_billed").desc(), "query_hash").limit(top_n)
    per_run = F.col("total_bytes_billed").cast("double") / F.col("run_count") / TIB
    monthly = _monthly(on_demand_cost(F.col("total_bytes_billed"), prices), window_days)
    hints = F.array_compact(
        F.array(
            F.when(F.upper(F.coalesce("sample_sql", F.lit(""))).contains("SELECT *"), F.lit(fixed.HINT_STAR)),
            F.when(
                F.col("run_count") >= 24 * window_days,
                fill(fixed.HINT_RUNS, n=fixed_point(F.col("run_count") / float(window_days), 0)),
            ),
            F.when(per_run > 1, fill(fixed.HINT_SCAN, n=fixed_point(per_run, 1))),
        )
    )
    text = F.when(F.size(hints) > 0, F.concat_ws("; ", hints)).otherwise(fixed.HINT_NONE)
    return finding(
        top,
        "expensive-query",
        F.col("query_hash"),
        _graded(monthly),
        monthly,
        text,
        details_json(
            user=F.col("user_email"),
            team=F.col("label_team"),
            runs=F.col("run_count"),
            bytes_billed=F.col("total_bytes_billed"),
            tables=F.coalesce("referenced_tables", F.array().cast("array<string>")),
        ),
    )


def scan_attribution(jobs: DataFrame) -> DataFrame:
    """Bytes of each job spread evenly over the tables it reads.

    A job without tables is attributed to nothing.  The shares are summed as decimals, so the
    result does not depend on the order of the rows.
    """
    share = (F.col("total_bytes_billed").cast("double") / F.size("referenced_tables")).cast("decimal(38,6)")
    return (
        jobs.select(F.explode("referenced_tables").alias("table"), share.alias("share"))
        .groupBy("table")
        .agg(F.sum("share").cast("double").alias("scan_bytes"))
    )


def table_layout(tables: DataFrame, jobs: DataFrame, prices: dict, window_days: int = 30) -> DataFrame:
    """Partitioning and clustering advice; the first branch that applies wins."""
    df = tables.filter(F.col("total_logical_bytes") >= 10 * fixed.GB).join(scan_attribution(jobs), "table", "left")
    no_text = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "scan_bytes": F.coalesce("scan_bytes", F.lit(0.0)),
            "cols": F.coalesce("typical_filter_columns", no_text),
            "partitioned": F.coalesce(F.col("partitioning") != "", F.lit(False)),
            "clustered": F.size(F.coalesce("clustering", no_text)) > 0,
        }
    )
    df = df.withColumn("date_col", F.get(F.filter("cols", looks_temporal), F.lit(0)))
    scan, cols, date_col = F.col("scan_bytes"), F.col("cols"), F.col("date_col")
    df = df.withColumn(
        "branch",
        F.when(~F.col("partitioned") & date_col.isNotNull(), 1)
        .when(~F.col("partitioned") & (F.size(cols) > 0) & (scan > 0), 2)
        .when(~F.col("clustered") & (scan > TIB), 3),
    ).filter("branch is not null")
    branch = F.col("branch")
    monthly = _monthly(on_demand_cost(scan, prices), window_days)
    size, scanned = fmt_bytes(F.col("total_logical_bytes")), fmt_bytes(scan)
    listed = F.concat_ws(", ", cols)
    return finding(
        df,
        F.when(branch == 1, "unpartitioned-table").otherwise("unclustered-table"),
        F.col("table"),
        F.when((branch == 1) & (monthly > 500), "high").when(branch == 1, "medium").otherwise("low"),
        F.when(branch == 1, monthly * 0.8).otherwise(monthly * 0.3),
        F.when(branch == 1, fill(fixed.PARTITION_TEXT, column=date_col))
        .when(branch == 2, fill(fixed.CLUSTER_ONLY_TEXT, columns=listed))
        .otherwise(fill(fixed.CLUSTER_TEXT, columns=listed)),
        F.when(
            branch == 1,
            details_json(
                size=size,
                scanned_in_window=scanned,
                partition_column=date_col,
                cluster_columns=F.filter(cols, lambda c: c != F.col("date_col")),
            ),
        )
        .when(branch == 2, details_json(size=size, scanned_in_window=scanned))
        .otherwise(details_json(scanned_in_window=scanned)),
    )


def partition_expiration(tables: DataFrame, prices: dict, stale_days: int = 60) -> DataFrame:
    """Partitioned tables without expiration that are stale or very large."""
    stale = F.col("last_modified_days_ago") >= stale_days
    long_term = F.coalesce("long_term_logical_bytes", F.lit(0))
    df = tables.filter(
        (F.col("partitioning") != "")
        & F.col("partition_expiration_days").isNull()
        & (stale | (F.col("total_logical_bytes") > 10 * fixed.TIB))
    )
    active_cost = F.col("active_logical_bytes") / GB * price(prices, "bigquery", "active_storage_gb_month")
    long_cost = long_term / GB * price(prices, "bigquery", "long_term_storage_gb_month") * 0.5
    return finding(
        df,
        "partition-expiration",
        F.col("table"),
        F.when(stale, "medium").otherwise("low"),
        F.when(stale, active_cost).otherwise(long_cost),
        F.when(stale, fill(fixed.STALE_TEXT, days=F.col("last_modified_days_ago"))).otherwise(
            fill(
                fixed.RETENTION_TEXT,
                pct=fmt_percent(F.try_divide(long_term.cast("double"), F.col("total_logical_bytes").cast("double"))),
            )
        ),
        details_json(size=fmt_bytes(F.col("total_logical_bytes"))),
    )


def long_term_candidates(tables: DataFrame, prices: dict) -> DataFrame:
    """Large unpartitioned tables rewritten often, whose data never ages into the cheaper price."""
    active_gb = F.col("active_logical_bytes") / GB
    gap = float(prices["bigquery"]["active_storage_gb_month"]) - float(prices["bigquery"]["long_term_storage_gb_month"])
    unpartitioned = F.coalesce(F.col("partitioning") == "", F.lit(True))
    return finding(
        tables.filter(unpartitioned & (active_gb > 1000) & (F.col("last_modified_days_ago") <= 7)),
        "long-term-storage",
        F.col("table"),
        F.lit("low"),
        active_gb * 0.7 * gap,
        F.lit(fixed.LONG_TERM_TEXT),
        details_json(active=fmt_bytes(F.col("active_logical_bytes"))),
    )


def analyze(
    jobs: DataFrame, tables: DataFrame, prices: dict, window_days: int = 30, top_n: int = 5, stale_days: int = 60
) -> DataFrame:
    return union_all(
        [
            expensive_queries(jobs, prices, window_days, top_n),
            table_layout(tables, jobs, prices, window_days),
            partition_expiration(tables, prices, stale_days),
            long_term_candidates(tables, prices),
        ]
    )


def slot_breakeven(jobs: DataFrame, prices: dict, window_days: int = 30) -> DataFrame:
    """Average slots used, the price of a 100-slot-step baseline, and the verdict."""
    exact = "decimal(38,0)"
    totals = jobs.agg(
        F.coalesce(F.sum(F.col("total_slot_ms").cast(exact)), F.lit(0)).cast("double").alias("slot_ms"),
        F.coalesce(F.sum(F.col("total_bytes_billed").cast(exact)), F.lit(0)).cast("double").alias("billed"),
    )
    df = totals.withColumn("slot_hours", F.col("slot_ms") / 3_600_000.0)
    df = df.withColumn("avg_slots", F.col("slot_hours") / (window_days * 24.0))
    # Half-even rounding: exactly 100 slots on average already need a second step.
    steps = F.bround(F.col("avg_slots") / 100.0 + 0.5, 0)
    df = df.withColumn("baseline", F.greatest(F.lit(100), (steps * 100).cast("bigint")))
    df = df.withColumn("on_demand", on_demand_cost(F.col("billed"), prices) * (30.0 / window_days))
    for name, key in (
        ("std", "slot_hour_standard_edition"),
        ("ent", "slot_hour_enterprise_edition"),
        ("ent_1y", "slot_hour_enterprise_1y_commit"),
    ):
        df = df.withColumn(name, F.col("baseline") * price(prices, "bigquery", key) * fixed.HOURS_PER_MONTH)
    cheapest, on_demand = F.least("std", "ent_1y"), F.col("on_demand")
    verdict = (
        F.when(
            on_demand > cheapest * 1.2,
            fill(fixed.SLOTS_MOVE, n=F.col("baseline"), pct=fmt_percent(on_demand / cheapest - 1)),
        )
        .when(on_demand < cheapest * 0.8, fixed.SLOTS_STAY)
        .otherwise(fixed.SLOTS_NEAR)
    )
    return df.select(
        F.lit(window_days).alias("window_days"),
        rounded(F.col("slot_hours"), 1).alias("total_slot_hours"),
        rounded(F.col("avg_slots"), 1).alias("avg_slots_needed"),
        rounded(on_demand).alias("on_demand_monthly"),
        rounded(F.col("std")).alias("slots_standard_monthly"),
        rounded(F.col("ent")).alias("slots_enterprise_monthly"),
        rounded(F.col("ent_1y")).alias("slots_enterprise_1y_monthly"),
        verdict.alias("recommendation"),
    )


def suggested_ddl(findings: DataFrame) -> DataFrame:
    """DDL text for unpartitioned tables and missing partition expirations."""
    resource = F.col("resource")
    column = F.get_json_object("details", "$.partition_column")
    cluster = F.concat_ws(", ", F.from_json(F.get_json_object("details", "$.cluster_columns"), "array<string>"))
    create = F.concat(
        fill(fixed.DDL_HEAD, table=resource, column=column),
        F.when(cluster != "", fill(fixed.DDL_CLUSTER, columns=cluster)).otherwise(""),
        fill(fixed.DDL_TAIL, table=resource),
    )
    alter = fill(fixed.DDL_EXPIRE, table=resource)
    return findings.filter(F.col("category").isin("unpartitioned-table", "partition-expiration")).select(
        "category", "resource", F.when(F.col("category") == "unpartitioned-table", create).otherwise(alter).alias("ddl")
    )


def top_users(log: DataFrame, now: dt.datetime, window_days: int = 30, top: int = 20) -> DataFrame:
    """The users who billed the most TiB."""
    return (
        log.filter((F.col("creation_time") > window_start(now, window_days)) & (F.col("job_type") == "QUERY"))
        .groupBy("user_email")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("total_bytes_billed").alias("billed"))
        .orderBy(F.col("billed").desc(), "user_email")
        .limit(top)
        .select("user_email", "runs", rounded(F.col("billed") / TIB).alias("tib"))
    )


def unguarded_tables(tables: DataFrame, min_bytes: int = 10**12) -> DataFrame:
    """Large tables that accept a query without a partition filter."""
    return tables.filter(
        (F.col("total_logical_bytes") > min_bytes) & ~F.coalesce("require_partition_filter", F.lit(False))
    ).select("table", "total_logical_bytes", (F.coalesce("partitioning", F.lit("")) != "").alias("partitioned"))


def storage_billing(tables: DataFrame, prices: dict, physical_gb_month: float) -> DataFrame:
    """Logical against physical storage billing per dataset."""
    exact = "decimal(38,0)"
    sums = tables.groupBy("dataset").agg(
        *[
            F.sum(F.col(f"{name}_bytes").cast(exact)).cast("double").alias(name)
            for name in ("active_logical", "long_term_logical", "total_physical")
        ]
    )
    logical = F.col("active_logical") / GB * price(prices, "bigquery", "active_storage_gb_month") + F.col(
        "long_term_logical"
    ) / GB * price(prices, "bigquery", "long_term_storage_gb_month")
    physical = F.col("total_physical") / GB * F.lit(float(physical_gb_month))
    return sums.select(
        "dataset",
        rounded(logical).alias("logical_monthly"),
        rounded(physical).alias("physical_monthly"),
        rounded(F.least(logical, physical)).alias("best_monthly"),
        F.when(physical < logical, "PHYSICAL").otherwise("LOGICAL").alias("best_model"),
    )
