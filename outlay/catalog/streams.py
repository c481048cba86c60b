"""Streaming and sink queries over the stored tables.

Streams read the stored files as a file source, run until all data is processed, and the result
table is read back from the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay import fixed, sinks
from outlay.binding import tables as b
from outlay.catalog import inventory
from outlay.catalog.metrics import SPARSE
from outlay.functions.money import rounded
from outlay.operators import anomalies, findings
from outlay.operators import metrics as m
from outlay.streaming import jobs

QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def stream_of(spark, sf, table):
    schema = b.stored(spark, sf, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


@query("S1_daily_rollup_stream")
def _(spark, sf):
    folder = sinks.shared_folder(spark, "rollup")
    rollup = jobs.daily_rollup(b.billing_lines(stream_of(spark, sf, "lineitem")))
    jobs.finish(jobs.start_append(rollup, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.schema(rollup.schema).parquet(f"{folder}/table")


@query("S2_spend_alerts_stream")
def _(spark, sf):
    folder = sinks.shared_folder(spark, "alerts")
    alerts = jobs.spend_alerts(b.billing_lines(stream_of(spark, sf, "lineitem")))
    jobs.finish(jobs.start_alerts(alerts, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.schema(alerts.schema).parquet(f"{folder}/table").select(*alerts.columns)


@query("S3_budget_alerts_stream")
def _(spark, sf):
    folder = sinks.shared_folder(spark, "budgets")
    lines = b.billing_lines(stream_of(spark, sf, "lineitem"))
    jobs.finish(jobs.start_budget_alerts(spark, lines, 500_000.0, f"{folder}/table", f"{folder}/checkpoint"))
    schema = "month string, project_id string, basis string, threshold double, actual_cost double, forecast_cost double, batch_id bigint"
    return spark.read.schema(schema).parquet(f"{folder}/table").drop("batch_id")


@query("S4_align_reduce_stream")
def _(spark, sf):
    folder = sinks.shared_folder(spark, "align")
    points = stream_of(spark, sf, "events").selectExpr(
        "concat('series-', user_id) as series", "event_type as namespace", "cast(ts as timestamp) as ts", "value"
    )
    aligned = jobs.align_reduce_stream(points, 3600, "mean", "sum", ["series"], ["namespace"])
    jobs.finish(jobs.start_append(aligned, f"{folder}/table", f"{folder}/checkpoint"))
    out = spark.read.schema(aligned.schema).parquet(f"{folder}/table")
    return out.select("namespace", F.col("period").cast("timestamp_ntz").alias("period"), rounded(F.col("value"), 4).alias("value"))


@query("T_rate_stream")
def _(spark, sf):
    """Rates of raw counters on a stream, of the cells that its end closes."""
    folder = sinks.shared_folder(spark, "rates")
    scrapes = m.real_containers(
        stream_of(spark, sf, "events").selectExpr(
            f"'{fixed.M_CPU_USAGE}' as metric",
            "'main' as cluster",
            "event_type as namespace",
            "concat('svc', user_id % 10, '-rs', user_id % 3, '-p', user_id) as pod",
            "case when user_id % 25 = 24 then 'POD' when user_id % 25 = 23 then '' else 'app' end as container",
            "cast(ts as timestamp) as ts",
            "cast(value as double) as value",
        )
    )
    rates = jobs.counter_rate_stream(scrapes, m.SERIES, max_gap=SPARSE)
    jobs.finish(jobs.start_append(rates, f"{folder}/table", f"{folder}/checkpoint"))
    out = spark.read.schema(rates.schema).parquet(f"{folder}/table")
    return out.select(*m.SERIES, F.col("grid").cast("timestamp_ntz").alias("grid"), rounded(F.col("value"), 6).alias("value"))


@query("SNK1_findings_sink")
def _(spark, sf):
    path = sinks.shared_folder(spark, "findings")
    found = inventory.all_findings(spark, sf)
    sinks.write_findings(found, path, b.AS_OF, fmt="json")
    columns = [*found.columns, "run_date"]
    return spark.read.schema(found.schema.add("run_date", "date")).json(path).select(*columns)


@query("SNK2_run_dated_report")
def _(spark, sf):
    """Two runs of one report, the second of them written twice."""
    base = sinks.shared_folder(spark, "reports")
    rollup = findings.category_rollup(inventory.all_findings(spark, sf))
    for day in (b.AS_OF.replace(day=17), b.AS_OF, b.AS_OF):
        path = sinks.write_report(rollup, base, "idle_by_category", day)
    return spark.read.parquet(path)


@query("SNK3_anomaly_feed")
def _(spark, sf):
    path = sinks.shared_folder(spark, "anomalies")
    found = anomalies.daily_anomalies(b.billing(spark, sf), b.AS_OF)
    sinks.append_anomalies(found, path)
    sinks.append_anomalies(found, path)
    return spark.read.schema(found.schema).parquet(path)
