"""Queries over stored series: what runs after one another leave behind."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from outlay import fixed, sinks
from outlay.binding import tables as b
from outlay.functions.dates import months_back
from outlay.functions.money import dmoney
from outlay.operators import metrics as m
from outlay.operators.quantiles import QuantileStore, rank_error, within_rank_error
from outlay.operators.series import DailySeries

QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def end_of(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(23, 59, 59))


@query("S1_restated_rollup")
def _(spark, sf):
    """A year of days: a first load, a run that picks up what came late, and that run once more."""
    series = DailySeries(spark, sinks.shared_folder(spark, "series"), months_back(b.AS_OF, 12))
    lines = b.billing(spark, sf)
    series.update(lines, end_of(b.AS_OF))
    later = end_of(b.AS_OF + dt.timedelta(days=2))
    for _ in range(2):
        series.update(lines, later)
    restated = F.col("stated_at") == F.lit(later).cast("timestamp_ntz")
    return series.days().select("usage_date", "project_id", "service", dmoney(F.col("net_cost")).alias("net_cost"), restated.alias("restated"))


@query("SNK3_incremental_anomalies")
def _(spark, sf):
    """Ten daily runs: each restates the days that changed, scores one day and adds it to the feed."""
    first = b.AS_OF - dt.timedelta(days=9 + 2 + 30)
    series, feed = DailySeries(spark, sinks.shared_folder(spark, "series"), first), sinks.shared_folder(spark, "anomalies")
    lines = series.landed(b.billing(spark, sf), sinks.shared_folder(spark, "export"), end_of(b.AS_OF))
    found = None
    for ago in range(9, -1, -1):
        as_of = b.AS_OF - dt.timedelta(days=ago)
        series.update(lines, end_of(as_of))
        found = series.anomalies(as_of)
        sinks.append_anomalies(found, feed)
    return spark.read.schema(found.schema).parquet(feed)


@query("T_nrp_sketches")
def _(spark, sf):
    """Nearest-rank percentiles of the lookback from daily sketches, and their true ranks."""
    points = m.gauge_last(m.metric(m.real_containers(b.samples(spark, sf)), fixed.M_MEM_WORKING_SET), m.SERIES)
    store = QuantileStore(spark, sinks.shared_folder(spark, "quantiles"), m.SERIES)
    last = b.METRIC_NOW.date() - dt.timedelta(days=1)
    first = last - dt.timedelta(days=13)
    # Two loads, the second of which states some days again.
    store.write_days(points, first, last - dt.timedelta(days=3))
    store.write_days(points, last - dt.timedelta(days=5), last)
    found = store.quantiles(first, last, p95=0.95)
    inside = points.filter((F.col("grid") >= F.lit(first)) & (F.col("grid") < F.lit(last + dt.timedelta(days=1))))
    series = store.series
    # Three times the error of 99 cases in 100, so that no series of many leaves it by chance.
    checked = within_rank_error(inside, found, series, 0.95, "p95", 3 * rank_error(store.k))
    exact = F.when(F.col("n") <= store.k, F.col("p95")).alias("p95")
    return found.select(*series, "highest", exact).join(checked, series).drop("metric")
