"""Metric queries over the stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from outlay import fixed
from outlay.binding import tables as b
from outlay.functions.money import dmoney, rounded
from outlay.operators import billing, metrics as m

NOW = b.METRIC_NOW
# The stored events are days apart where scrapes are seconds apart: gaps are bridged, and a series
# counts as alive for some days.
SPARSE = dt.timedelta(days=10_000)
ALIVE = dt.timedelta(days=3)
CPU_HOUR = fixed.DEFAULT_PRICES["kubernetes"]["vcpu_hour"]
GB_HOUR = fixed.DEFAULT_PRICES["kubernetes"]["gb_hour"]
QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _r(df, *names, digits=4):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def _mem_points(spark, sf):
    return m.gauge_last(m.real_containers(m.metric(b.samples(spark, sf), fixed.M_MEM_WORKING_SET)), m.SERIES)


@query("SRC7_metric_samples")
def _(spark, sf):
    return b.samples(spark, sf).groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("K1_usage_from_samples")
def _(spark, sf):
    usage = m.usage_from_samples(b.samples(spark, sf), NOW, staleness=ALIVE, max_gap=SPARSE)
    numbers = [c for c in usage.columns if c.endswith(("_m", "_mi", "_p95", "_14d")) and c != "mem_limit_mi"]
    return _r(usage, *numbers).drop("kind", "mem_limit_mi")


@query("T_rate")
def _(spark, sf):
    usage = m.real_containers(m.metric(b.samples(spark, sf), fixed.M_CPU_USAGE))
    return _r(m.counter_rate(usage, m.SERIES, max_gap=SPARSE), "value", digits=6).drop("metric")


@query("T_incr")
def _(spark, sf):
    return _r(m.increase_over(m.metric(b.samples(spark, sf), fixed.M_OOM_EVENTS), m.SERIES), "increase").drop("metric")


@query("T_qot")
def _(spark, sf):
    return _r(m.quantile_over_time(_mem_points(spark, sf), m.SERIES, 0.95), "value").drop("metric")


@query("T_mot")
def _(spark, sf):
    return m.max_over_time(_mem_points(spark, sf), m.SERIES).drop("metric")


@query("T_nrp")
def _(spark, sf):
    return m.nearest_rank(_mem_points(spark, sf), m.SERIES, 0.95).drop("metric")


@query("T1_cpu_totals")
def _(spark, sf):
    return _r(m.cluster_totals(b.samples(spark, sf), "cpu", max_gap=SPARSE), "allocatable", "requested", "used")


@query("T2_memory_totals")
def _(spark, sf):
    return m.cluster_totals(b.samples(spark, sf), "memory")


@query("T3_requested_unused_cpu")
def _(spark, sf):
    return _r(m.requested_unused(m.cluster_totals(b.samples(spark, sf), "cpu", max_gap=SPARSE)), "unused")


def _usage(spark, sf):
    return m.namespace_usage(b.samples(spark, sf), max_gap=SPARSE)


@query("T4_unused_cpu_by_namespace")
def _(spark, sf):
    return _r(m.unused_by_namespace(_usage(spark, sf), "cpu"), "unused")


@query("T5_unused_memory_by_namespace")
def _(spark, sf):
    return m.unused_by_namespace(_usage(spark, sf), "mem")


@query("T6_cpu_utilisation")
def _(spark, sf):
    return _r(m.utilisation_by_namespace(_usage(spark, sf), "cpu"), "utilisation_pct")


@query("T7_memory_utilisation")
def _(spark, sf):
    return _r(m.utilisation_by_namespace(_usage(spark, sf), "mem"), "utilisation_pct")


@query("T8_throttling_top")
def _(spark, sf):
    return m.throttling_top(b.samples(spark, sf), NOW, lookback=dt.timedelta(days=2), reach=dt.timedelta(days=7), max_gap=SPARSE)


@query("T9_oom_counts")
def _(spark, sf):
    return _r(m.oom_counts(b.samples(spark, sf), NOW, lookback=dt.timedelta(days=5)), "oom_kills")


@query("T10_request_cost")
def _(spark, sf):
    return _r(m.request_cost(_usage(spark, sf), CPU_HOUR, GB_HOUR), "monthly_cost", digits=2)


@query("T11_waste_cost")
def _(spark, sf):
    return _r(m.waste_cost(_usage(spark, sf), CPU_HOUR, GB_HOUR), "monthly_waste", digits=2)


@query("T12_spot_share")
def _(spark, sf):
    return m.spot_share(b.node_labels(spark, sf), NOW, ALIVE)


@query("T13_blocking_budgets")
def _(spark, sf):
    return m.blocking_budgets(b.disruption_budgets(spark, sf), NOW, ALIVE)


@query("T13_blocking_budget_count")
def _(spark, sf):
    return m.blocking_budgets(b.disruption_budgets(spark, sf), NOW, ALIVE).agg(F.count(F.lit(1)).alias("blocking"))


@query("T14_label_values")
def _(spark, sf):
    samples = m.metric(b.samples(spark, sf), fixed.M_CPU_REQUEST)
    clusters = m.label_values(samples, "cluster").select(F.lit("cluster").alias("label"), F.col("cluster").alias("label_value"))
    spaces = m.label_values(samples, "namespace", cluster="main")
    return clusters.unionByName(spaces.select(F.lit("namespace").alias("label"), F.col("namespace").alias("label_value")))


@query("T15_rightsizing_candidates")
def _(spark, sf):
    usage = m.namespace_usage(b.samples(spark, sf), step="1 hour", seconds=3600.0, max_gap=SPARSE)
    return m.rightsizing_candidates(usage, NOW)


@query("D13_scale_down_nodes")
def _(spark, sf):
    return m.scale_down_nodes(b.samples(spark, sf), NOW, staleness=ALIVE)


# ------------------------------------------------------------------ align and reduce
CHARTS = {
    "A0_align_reduce": (1800, "min", "max", ["namespace"]),
    "A1_instance_cpu": (3600, "p50", "mean", ["instance"]),
    "A2_allocatable_cores": (3600, "mean", "sum", ["cluster"]),
    "A3_cpu_request_utilisation": (3600, "mean", "mean", ["namespace"]),
    "A4_memory_request_utilisation": (3600, "mean", "mean", ["namespace"]),
    "A5_sql_connections": (3600, "max", "max", ["database"]),
    "A6_cache_usage": (3600, "mean", "mean", ["instance"]),
    "A7_scanned_bytes": (3600, "delta", "sum", []),
    "A8_bytes_by_class": (3600, "mean", "sum", ["storage_class"]),
    "A9_sent_bytes": (3600, "rate", "sum", ["instance"]),
}


def _chart(period, aligner, reducer, fields):
    def run(spark, sf):
        series = ["series", "namespace"]
        return _r(m.align_reduce(b.monitoring(spark, sf), period, aligner, reducer, series, fields), "value")

    return run


for _name, _args in CHARTS.items():
    QUERIES[_name] = _chart(*_args)


@query("A10_cost_scorecard")
def _(spark, sf):
    """Daily cost per project as a gauge, highest value of the day, summed over the projects."""
    cost = b.billing(spark, sf).select(
        billing.project_or_account().alias("project"), F.col("usage_start_time").alias("ts"), billing.line_net().alias("value")
    )
    daily = m.scorecard(m.align_reduce(cost, 86400, "max", "sum", ["project"], []))
    return daily.withColumn("value", dmoney(F.col("value")))
