"""Metric time series: counters, gauges, dashboard panels and align/reduce.

``samples`` is a long table (metric, cluster, namespace, pod, container, node, ts, value) with at
most one sample per series and timestamp.  Counters are handled on a time grid in two levels:
inside a grid cell deltas come from neighbouring samples, and between cells from the first and last
sample of each cell.  A cell holds the scrapes of one series in one step and a series holds the
cells of the lookback, so no window grows with the number of samples of a hot series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import ts_lit
from outlay.functions.money import ratio, rounded
from outlay.functions.text import workload_of_pod
from outlay.operators.findings import union_all

SERIES = ["cluster", "namespace", "pod", "container"]
STEP = "5 minutes"
STEP_SECONDS = 300.0
# A series whose last sample is older than this is gone, as in an instant query.
STALENESS = dt.timedelta(minutes=5)
# The default time range of a panel that is asked for one.
PANEL_RANGE = dt.timedelta(hours=24)


def metric(samples: DataFrame, *names: str) -> DataFrame:
    return samples.filter(F.col("metric").isin(*names))


def real_containers(samples: DataFrame) -> DataFrame:
    """Without the pause container and the pod-level sums, which carry no container name."""
    return samples.filter(~F.coalesce("container", F.lit("")).isin("", "POD"))


def between(samples: DataFrame, now: dt.datetime, lookback: dt.timedelta) -> DataFrame:
    return samples.filter((F.col("ts") >= ts_lit(now - lookback)) & (F.col("ts") < ts_lit(now)))


def recent(samples: DataFrame, now: dt.datetime | None, lookback: dt.timedelta) -> DataFrame:
    """The samples of a panel's time range; all of them where ``now`` is left out."""
    return samples if now is None else between(samples, now, lookback)


def alive(samples: DataFrame, now: dt.datetime, staleness: dt.timedelta = STALENESS) -> DataFrame:
    """The samples an instant query at ``now`` can see."""
    return between(samples, now, staleness)


def grid(step: str = STEP) -> Column:
    return F.window("ts", step)["start"]


def _rise(now: Column, before: Column) -> Column:
    """Counter delta; a fall is a reset and counts the new value, the first sample counts 0."""
    return F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)


def counter_increase(samples: DataFrame, keys: list[str], step: str = STEP, max_gap: dt.timedelta | None = None) -> DataFrame:
    """Reset-aware increase per metric, series and grid cell.

    The increase between two samples belongs to the cell of the later one. See ``increase_of_cells``.
    """
    return increase_of_cells(counter_cells(samples, keys, step), keys, max_gap)


def counter_cells(samples: DataFrame, keys: list[str], step: str = STEP) -> DataFrame:
    """Increase inside each cell, with its first and last value.

    The window leaves its rows in the order of the cells. Minima of structs are added up in that order, where
    ``min_by`` would take a hash table of all cells of the task.
    """
    series = ["metric", *keys]
    cell = Window.partitionBy(*series, "grid").orderBy("ts")
    value, point = F.col("value"), F.struct("ts", "value")
    return (
        samples.select(*series, grid(step).alias("grid"), "ts", "value")
        .withColumn("rise", _rise(value, F.lag("value").over(cell)))
        .groupBy(*series, "grid")
        .agg(
            F.sum("rise").alias("inner"),
            F.min(point)["value"].alias("first_value"),
            F.max(point)["value"].alias("last_value"),
            F.count("value").alias("scrapes"),
        )
    )


def _stepped(cell: Column, before: Column, max_gap: dt.timedelta | None) -> Column:
    """Increase of a cell after the one ``before``, NULL where there is none; see ``increase_of_cells``."""
    increase = cell["inner"] + _rise(cell["first_value"], before["last_value"])
    if max_gap is None:
        return increase
    gone = F.unix_seconds(cell["grid"].cast("timestamp")) - F.unix_seconds(before["grid"].cast("timestamp")) > max_gap.total_seconds()
    return F.when(F.coalesce(gone, F.lit(False)), F.when(cell["scrapes"] > 1, cell["inner"])).otherwise(increase)


def increase_of_cells(cells: DataFrame, keys: list[str], max_gap: dt.timedelta | None = None) -> DataFrame:
    """Increase inside each cell plus the step from the last value of the cell before.

    With ``max_gap`` the step over a longer gap between cells is unknown and left out; a cell with a
    single sample then has no increase (NULL).
    """
    by_cell = Window.partitionBy("metric", *keys).orderBy("grid")
    cell = F.struct("inner", "first_value", "last_value", "scrapes", "grid")
    rest = [c for c in cells.columns if c not in ("inner", "first_value", "last_value", "scrapes")]
    return cells.select(*rest, _stepped(cell, F.lag(cell).over(by_cell), max_gap).alias("increase"))


def counter_rate(
    samples: DataFrame, keys: list[str], step: str = STEP, seconds: float = STEP_SECONDS, max_gap: dt.timedelta | None = None
) -> DataFrame:
    """Per-second rate per series and cell: the increase over the length of the cell.

    A gap beyond ``max_gap``, twice the cell by default, has no rate.
    """
    increase = counter_increase(samples, keys, step, dt.timedelta(seconds=2 * seconds) if max_gap is None else max_gap)
    rate = increase.select("metric", *keys, "grid", (F.col("increase") / seconds).alias("value"))
    return rate.filter(F.col("value").isNotNull())


def gauge_last(samples: DataFrame, keys: list[str], step: str = STEP) -> DataFrame:
    """Last value per series and cell."""
    return samples.groupBy("metric", *keys, grid(step).alias("grid")).agg(F.max_by("value", "ts").alias("value"))


def increase_over(samples: DataFrame, keys: list[str], step: str = "1 hour") -> DataFrame:
    """Counter increase over the whole range of the samples."""
    return counter_increase(samples, keys, step).groupBy("metric", *keys).agg(F.sum("increase").alias("increase"))


def quantile_over_time(points: DataFrame, keys: list[str], q: float, exact: bool = True) -> DataFrame:
    """Interpolated quantile of the grid points of each series."""
    quantile = F.percentile("value", q) if exact else F.percentile_approx("value", q)
    return points.groupBy("metric", *keys).agg(quantile.alias("value"))


def max_over_time(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy("metric", *keys).agg(F.max("value").alias("value"))


def nearest_rank(points: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Nearest-rank percentile of the grid points of each series."""
    disc = F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return points.groupBy("metric", *keys).agg(disc.alias("value"))


# ------------------------------------------------------------------ usage for rightsizing
def usage_from_samples(
    samples: DataFrame,
    now: dt.datetime,
    lookback_days: int = 14,
    staleness: dt.timedelta = STALENESS,
    max_gap: dt.timedelta = 2 * dt.timedelta(seconds=STEP_SECONDS),
    cluster: str | None = None,
) -> DataFrame:
    """Usage summary per (namespace, workload, container), the maximum over the pods of all clusters or one.

    A pod counts as a replica with its request if that is alive at ``now``; usage covers the lookback,
    also of pods that are gone. Rates leave out gaps beyond ``max_gap``; kills are counted over them.

    All series are first reduced to grid cells.  One repartition of the cells by pod then serves the
    metrics side by side, the steps between cells, and the percentiles: the cells are sorted once, and
    no hash table holds them.
    """
    keys = SERIES
    if cluster is not None:
        samples = samples.filter(F.col("cluster") == cluster)
    recent = between(samples, now, dt.timedelta(days=lookback_days))
    counters = union_all(
        [
            metric(real_containers(recent), fixed.M_CPU_USAGE),
            metric(recent, fixed.M_THROTTLED, fixed.M_PERIODS, fixed.M_OOM_EVENTS),
        ]
    )
    gauges = union_all(
        [
            metric(real_containers(recent), fixed.M_MEM_WORKING_SET),
            metric(alive(recent, now, staleness), fixed.M_CPU_REQUEST, fixed.M_MEM_REQUEST),
        ]
    )
    cells = counter_cells(counters, keys).unionByName(
        gauge_last(gauges, keys).withColumnRenamed("value", "gauge"), allowMissingColumns=True
    )
    cell = F.struct("inner", "first_value", "last_value", "scrapes", "grid")

    def side(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("metric") == name, value)).alias(name)

    steps = [fixed.M_CPU_USAGE, fixed.M_THROTTLED, fixed.M_PERIODS, fixed.M_OOM_EVENTS]
    levels = [fixed.M_MEM_WORKING_SET, fixed.M_CPU_REQUEST, fixed.M_MEM_REQUEST]
    # One cell for each metric, so each maximum is of one value.
    sides = cells.repartition(*keys).groupBy(*keys, "grid").agg(
        *[side(name, cell) for name in steps], *[side(name, F.col("gauge")) for name in levels]
    )
    earlier = Window.partitionBy(*keys).orderBy("grid").rowsBetween(Window.unboundedPreceding, -1)
    sides = sides.withColumns({f"{name}_before": F.last(name, ignorenulls=True).over(earlier) for name in steps})

    def rise(name: str, gap: dt.timedelta | None = max_gap) -> Column:
        return _stepped(F.col(name), F.col(f"{name}_before"), gap)

    wide = sides.select(
        *keys,
        "grid",
        (rise(fixed.M_CPU_USAGE) / STEP_SECONDS).alias("cpu"),
        F.col(fixed.M_MEM_WORKING_SET).alias("mem"),
        ratio(rise(fixed.M_THROTTLED), rise(fixed.M_PERIODS)).alias("throttled"),
        rise(fixed.M_OOM_EVENTS, None).alias("oom"),
        F.col(fixed.M_CPU_REQUEST).alias("cpu_request"),
        F.col(fixed.M_MEM_REQUEST).alias("mem_request"),
    )

    def latest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("grid")))

    pods = wide.groupBy(*keys).agg(
        F.percentile("cpu", 0.95).alias("p95"),
        F.percentile("cpu", 0.99).alias("p99"),
        F.max("cpu").alias("cpu_max"),
        F.percentile("mem", 0.99).alias("m99"),
        F.max("mem").alias("mem_max"),
        F.percentile("throttled", 0.95).alias("thr"),
        F.sum("oom").alias("oom"),
        latest("cpu_request").alias("cpu_request"),
        latest("mem_request").alias("mem_request"),
    )
    mib = float(1024 * 1024)
    usage = pods.groupBy("namespace", workload_of_pod(F.col("pod")).alias("workload"), "container").agg(
        F.count("cpu_request").cast("int").alias("replicas"),
        (F.max("p95") * 1000).alias("cpu_p95_m"),
        (F.max("p99") * 1000).alias("cpu_p99_m"),
        (F.max("cpu_max") * 1000).alias("cpu_max_m"),
        (F.max("m99") / mib).alias("mem_p99_mi"),
        (F.max("mem_max") / mib).alias("mem_max_mi"),
        (F.max("cpu_request") * 1000).alias("cpu_request_m"),
        (F.max("mem_request") / mib).alias("mem_request_mi"),
        F.coalesce(F.max("thr"), F.lit(0.0)).alias("throttled_ratio_p95"),
        F.coalesce(F.max("oom"), F.lit(0.0)).alias("oom_kills_14d"),
    )
    return usage.filter((F.col("cpu_request_m") > 0) & F.col("cpu_p95_m").isNotNull()).withColumns(
        {"kind": F.lit("Deployment"), "mem_limit_mi": F.lit(0)}
    )


# ------------------------------------------------------------------ cluster panels
def cluster_totals(
    samples: DataFrame,
    resource: str,
    step: str = STEP,
    seconds: float = STEP_SECONDS,
    max_gap: dt.timedelta | None = None,
    now: dt.datetime | None = None,
    lookback: dt.timedelta = PANEL_RANGE,
) -> DataFrame:
    """Allocatable, requested and used per cluster and grid cell; ``resource`` is cpu or memory.

    With ``now`` only the samples of the ``lookback`` before it are read.
    """
    samples = recent(samples, now, lookback)
    if resource == "cpu":
        names = (fixed.M_ALLOC_CPU, fixed.M_CPU_REQUEST)
        used = counter_rate(metric(real_containers(samples), fixed.M_CPU_USAGE), SERIES, step, seconds, max_gap)
        used_name = fixed.M_CPU_USAGE
    else:
        names = (fixed.M_ALLOC_MEM, fixed.M_MEM_REQUEST)
        used = gauge_last(metric(real_containers(samples), fixed.M_MEM_WORKING_SET), SERIES, step)
        used_name = fixed.M_MEM_WORKING_SET
    nodes = gauge_last(metric(samples, names[0]), ["cluster", "node"], step)
    requests = gauge_last(metric(samples, names[1]), SERIES, step)
    points = union_all([df.select("cluster", "metric", "grid", "value") for df in (nodes, requests, used)])
    return points.groupBy("cluster", "grid").agg(
        F.sum(F.when(F.col("metric") == names[0], F.col("value"))).alias("allocatable"),
        F.sum(F.when(F.col("metric") == names[1], F.col("value"))).alias("requested"),
        F.sum(F.when(F.col("metric") == used_name, F.col("value"))).alias("used"),
    )


def requested_unused(totals: DataFrame) -> DataFrame:
    """Requested minus used; negative when usage exceeds the requests."""
    both = totals.filter(F.col("requested").isNotNull() & F.col("used").isNotNull())
    return both.select("cluster", "grid", (F.col("requested") - F.col("used")).alias("unused"))


def namespace_usage(
    samples: DataFrame,
    step: str = STEP,
    seconds: float = STEP_SECONDS,
    cluster: str | None = None,
    max_gap: dt.timedelta | None = None,
) -> DataFrame:
    """CPU and memory requested and used per namespace and grid cell, in one aggregation."""
    if cluster is not None:
        samples = samples.filter(F.col("cluster") == cluster)
    used = counter_rate(metric(real_containers(samples), fixed.M_CPU_USAGE), SERIES, step, seconds, max_gap)
    working = gauge_last(metric(real_containers(samples), fixed.M_MEM_WORKING_SET), SERIES, step)
    requests = gauge_last(metric(samples, fixed.M_CPU_REQUEST, fixed.M_MEM_REQUEST), SERIES, step)
    points = union_all([used, working, requests])

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("metric") == name, F.col("value")))

    return points.groupBy("namespace", "grid").agg(
        total(fixed.M_CPU_REQUEST).alias("cpu_requested"),
        total(fixed.M_CPU_USAGE).alias("cpu_used"),
        total(fixed.M_MEM_REQUEST).alias("mem_requested"),
        total(fixed.M_MEM_WORKING_SET).alias("mem_used"),
    )


def _both(usage: DataFrame, resource: str) -> DataFrame:
    """A namespace shows up only where both sides of the operation have a value."""
    return usage.filter(F.col(f"{resource}_requested").isNotNull() & F.col(f"{resource}_used").isNotNull())


def _idle(resource: str) -> Column:
    return F.greatest(F.col(f"{resource}_requested") - F.col(f"{resource}_used"), F.lit(0.0))


def unused_by_namespace(usage: DataFrame, resource: str) -> DataFrame:
    return _both(usage, resource).select("namespace", "grid", _idle(resource).alias("unused"))


def utilisation_by_namespace(usage: DataFrame, resource: str) -> DataFrame:
    util = 100 * ratio(F.col(f"{resource}_used"), F.col(f"{resource}_requested"))
    return _both(usage, resource).select("namespace", "grid", util.alias("utilisation_pct"))


def request_cost(usage: DataFrame, cpu_hour: float, gb_hour: float) -> DataFrame:
    """Monthly cost of the requested capacity."""
    both = usage.filter(F.col("cpu_requested").isNotNull() & F.col("mem_requested").isNotNull())
    cost = (F.col("cpu_requested") * cpu_hour + F.col("mem_requested") / float(fixed.GIB) * gb_hour) * fixed.HOURS_PER_MONTH
    return both.select("namespace", "grid", cost.alias("monthly_cost"))


def waste_cost(usage: DataFrame, cpu_hour: float, gb_hour: float) -> DataFrame:
    """Monthly cost of the capacity requested but not used."""
    both = _both(_both(usage, "cpu"), "mem")
    cost = (_idle("cpu") * cpu_hour + _idle("mem") / float(fixed.GIB) * gb_hour) * fixed.HOURS_PER_MONTH
    return both.select("namespace", "grid", cost.alias("monthly_waste"))


def throttling_top(
    samples: DataFrame,
    now: dt.datetime,
    lookback: dt.timedelta = dt.timedelta(hours=1),
    reach: dt.timedelta = dt.timedelta(minutes=5),
    top: int = 15,
    max_gap: dt.timedelta = 2 * dt.timedelta(seconds=STEP_SECONDS),
) -> DataFrame:
    """The containers with the highest 95th percentile of throttled to all scheduling periods.

    ``reach`` is how far before the lookback the first previous sample is looked for.
    """
    keys = SERIES
    recent = between(metric(samples, fixed.M_THROTTLED, fixed.M_PERIODS), now, lookback + reach)
    cells = counter_increase(recent, keys, max_gap=max_gap).filter(F.col("grid") >= ts_lit(now - lookback))

    def of(name: str) -> Column:
        return F.sum(F.when(F.col("metric") == name, F.col("increase")))

    ratios = cells.groupBy(*keys, "grid").agg(ratio(of(fixed.M_THROTTLED), of(fixed.M_PERIODS)).alias("ratio"))
    return (
        ratios.groupBy(*keys)
        .agg(rounded(F.percentile("ratio", 0.95), 6).alias("throttled_p95"))
        .filter(F.col("throttled_p95").isNotNull())
        .orderBy(F.col("throttled_p95").desc(), *keys)
        .limit(top)
    )


def oom_counts(
    samples: DataFrame, now: dt.datetime, lookback: dt.timedelta = dt.timedelta(hours=24), name: str = fixed.M_OOM_TERMINATED
) -> DataFrame:
    recent = between(metric(samples, name), now, lookback)
    return (
        increase_over(recent, SERIES)
        .groupBy("namespace", "container")
        .agg(F.sum("increase").alias("oom_kills"))
    )


def spot_share(nodes: DataFrame, now: dt.datetime, staleness: dt.timedelta = STALENESS) -> DataFrame:
    """Nodes alive at ``now`` by their latest spot label."""
    latest = alive(nodes, now, staleness).groupBy("cluster", "node").agg(F.max_by("spot", "ts").alias("spot"))
    return latest.groupBy("spot").agg(F.count(F.lit(1)).alias("nodes"))


def blocking_budgets(budgets: DataFrame, now: dt.datetime, staleness: dt.timedelta = STALENESS) -> DataFrame:
    """Disruption budgets alive at ``now`` whose latest value allows no eviction."""
    latest = alive(budgets, now, staleness).groupBy("cluster", "namespace", "pdb").agg(F.max_by("value", "ts").alias("allowed"))
    return latest.filter(F.col("allowed") == 0).select("cluster", "namespace", "pdb")


def label_values(samples: DataFrame, label: str, now: dt.datetime | None = None, lookback: dt.timedelta = PANEL_RANGE, **chosen: str) -> DataFrame:
    """Distinct values of a label, restricted by labels already chosen and, with ``now``, to the lookback."""
    samples = recent(samples, now, lookback)
    for name, value in chosen.items():
        samples = samples.filter(F.col(name) == value)
    return samples.select(label).distinct()


def rightsizing_candidates(usage: DataFrame, now: dt.datetime, days: int = 7, below_pct: float = 40.0) -> DataFrame:
    """Namespaces whose utilisation stayed below the limit on each of the last days."""
    week = usage.filter((F.col("grid") >= ts_lit(now - dt.timedelta(days=days))) & (F.col("grid") < ts_lit(now)))

    def util(resource: str) -> Column:
        return 100 * ratio(F.col(f"{resource}_used"), F.col(f"{resource}_requested"))

    daily = week.groupBy("namespace", F.to_date("grid").alias("day")).agg(
        F.max(util("cpu")).alias("cpu"), F.max(util("mem")).alias("mem")
    )
    return (
        daily.groupBy("namespace")
        .agg(
            F.count("cpu").alias("cpu_days"),
            F.count("mem").alias("mem_days"),
            F.max("cpu").alias("cpu_max_pct"),
            F.max("mem").alias("mem_max_pct"),
        )
        .select(
            "namespace",
            rounded(F.col("cpu_max_pct"), 4).alias("cpu_max_pct"),
            rounded(F.col("mem_max_pct"), 4).alias("mem_max_pct"),
            ((F.col("cpu_days") == days) & (F.col("cpu_max_pct") < below_pct)).alias("cpu_candidate"),
            ((F.col("mem_days") == days) & (F.col("mem_max_pct") < below_pct)).alias("mem_candidate"),
        )
        .filter(F.col("cpu_candidate") | F.col("mem_candidate"))
    )


def scale_down_nodes(samples: DataFrame, now: dt.datetime, threshold: float = 0.5, staleness: dt.timedelta = STALENESS) -> DataFrame:
    """Nodes whose requests alive at ``now`` stay below a share of what they can allocate."""
    samples = alive(samples, now, staleness)
    requests = metric(samples, fixed.M_CPU_REQUEST, fixed.M_MEM_REQUEST)
    latest = requests.groupBy("metric", "node", *SERIES).agg(F.max_by("value", "ts").alias("value"))
    capacity = metric(samples, fixed.M_ALLOC_CPU, fixed.M_ALLOC_MEM)
    allocatable = capacity.groupBy("metric", "cluster", "node").agg(F.max_by("value", "ts").alias("value"))
    points = latest.select("metric", "cluster", "node", "value").unionByName(allocatable)

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("metric") == name, F.col("value")))

    return (
        points.groupBy("cluster", "node")
        .agg(
            rounded(ratio(total(fixed.M_CPU_REQUEST), total(fixed.M_ALLOC_CPU)), 4).alias("cpu_ratio"),
            rounded(ratio(total(fixed.M_MEM_REQUEST), total(fixed.M_ALLOC_MEM)), 4).alias("mem_ratio"),
        )
        .filter((F.col("cpu_ratio") < threshold) & (F.col("mem_ratio") < threshold))
    )


# ------------------------------------------------------------------ align and reduce
ALIGNERS = {
    "mean": lambda v, s: F.avg(v),
    "max": lambda v, s: F.max(v),
    "min": lambda v, s: F.min(v),
    "p50": lambda v, s: F.percentile(v, 0.5),
    "delta": lambda v, s: F.sum(v),
    "rate": lambda v, s: F.sum(v) / float(s),
}
REDUCERS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def align_reduce(
    points: DataFrame, period_seconds: int, aligner: str, reducer: str, series: list[str], group_by: list[str]
) -> DataFrame:
    """Align every series to fixed periods, then reduce the series of each group.

    For delta metrics the values are already deltas, so ``delta`` adds them up and ``rate`` also
    divides by the period.  Works on streams too when the input carries a watermark.
    """
    period = F.window("ts", f"{period_seconds} seconds")["start"]
    by_series = list(dict.fromkeys([*series, *group_by]))
    aligned = points.groupBy(*by_series, period.alias("period")).agg(
        ALIGNERS[aligner](F.col("value"), period_seconds).alias("value")
    )
    return aligned.groupBy(*group_by, "period").agg(REDUCERS[reducer]("value").alias("value"))


def scorecard(daily: DataFrame, yellow: float = fixed.SCORECARD_YELLOW, red: float = fixed.SCORECARD_RED) -> DataFrame:
    value = F.col("value")
    return daily.withColumn("band", F.when(value >= red, "RED").when(value >= yellow, "YELLOW").otherwise("GREEN"))
