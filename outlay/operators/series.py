"""A stored daily spend series that is restated by days and scored from moments.

Lines reach the export late, and a report that is only appended to stays wrong for their days.  The series
is a table partitioned by usage day.  A run looks at the lines exported since the last run, which are those
of the latest ingestion days, and recomputes just the usage days they belong to, each from all its lines, so
a day is the same however often and in whatever order it is restated.

Beside the days lie blocks of ``BLOCK_DAYS`` days with the count, mean and squared deviations of each key.
They merge, so the baseline of a day is merged from a few blocks and single days, and a daily run
neither rereads five weeks of lines nor five weeks of days.

An export that is a view over something else is derived anew by every run.  ``DailySeries.landed`` writes the
covered lines once, by ingestion day, so that each run after it opens the partitions it needs only.

Layout below one path: ``days/usage_date=…``, ``blocks/block=…``, ``runs/until=…``.  A run is recorded last:
one that was lost midway is repeated from the same state and writes the same partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions.dates import day_lit, ts_lit
from outlay.operators.anomalies import KEYS, daily_cost, verdicts
from outlay.sinks import overwrite_partitions
from outlay.sources.billing import regular_only, usage_day

BLOCK_DAYS = 6
DAYS = "project_id string, service string, net_cost decimal(38,10), stated_at timestamp_ntz, usage_date date"
BLOCKS = "project_id string, service string, n bigint, mean double, m2 double, block int"
RUNS = "since timestamp_ntz, days int, until timestamp_ntz"
MOMENTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])
EPOCH = dt.date(1970, 1, 1)
LANDED = ["usage_start_time", "export_time", "cost_type", "project", "service", "cost", "credits", "ingest_date"]


def changed_days(lines: DataFrame, since: dt.datetime | None, until: dt.datetime, slack: int = 1) -> DataFrame:
    """``usage_date`` of the regular lines exported after ``since`` and up to ``until``.

    A line is ingested on the day of its export or up to ``slack`` days beside it, so only the newest
    partitions are read.
    """
    fresh = _exported(regular_only(lines), until, slack)
    if since is not None:
        early = since.date() - dt.timedelta(days=slack)
        fresh = fresh.filter((F.col("ingest_date") >= day_lit(early)) & (F.col("export_time") > ts_lit(since)))
    return fresh.select(usage_day().alias("usage_date")).distinct()


def _exported(lines: DataFrame, until: dt.datetime, slack: int) -> DataFrame:
    late = until.date() + dt.timedelta(days=slack)
    return lines.filter((F.col("ingest_date") <= day_lit(late)) & (F.col("export_time") <= ts_lit(until)))


def day_ranges(days: Iterable[dt.date], most: int = 64) -> list[tuple[dt.date, dt.date]]:
    """Ranges that cover ``days``, as few as ``most`` by closing the narrowest gaps."""
    ordered = sorted(days)
    gaps = sorted(((b - a).days, i) for i, (a, b) in enumerate(zip(ordered, ordered[1:])))
    cuts = sorted(i for gap, i in gaps[::-1][: most - 1] if gap > 1)
    starts = [0, *(i + 1 for i in cuts)]
    return [(ordered[a], ordered[b - 1]) for a, b in zip(starts, [*starts[1:], len(ordered)])] if ordered else []


def lines_of_days(lines: DataFrame, days: list[dt.date], until: dt.datetime, slack: int = 1) -> DataFrame:
    """All regular lines of ``days`` exported up to ``until``.

    The ranges are literals and reach the scan; the days themselves, one value each, decide.
    """
    wanted = None
    for first, last in day_ranges(days):
        inside = usage_day().between(day_lit(first), day_lit(last))
        wanted = inside if wanted is None else wanted | inside
    early = min(days) - dt.timedelta(days=slack)
    known = lines.sparkSession.createDataFrame([(d,) for d in days], "usage_date date")
    near = _exported(regular_only(lines), until, slack).filter((F.col("ingest_date") >= day_lit(early)) & wanted)
    return near.join(F.broadcast(known), usage_day() == F.col("usage_date"), "left_semi")


def merged(pieces: Column) -> Column:
    """Count, mean and squared deviations of an array of moments put together."""

    def step(a: Column, b: Column) -> Column:
        n = a.n + b.n
        gap = b.mean - a.mean
        mean = F.when(n > 0, a.mean + gap * b.n / n).otherwise(F.lit(0.0))
        m2 = a.m2 + b.m2 + F.when(n > 0, gap * gap * a.n * b.n / n).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")).cast(MOMENTS)

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).cast(MOMENTS)
    return F.aggregate(pieces, zero, step)


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.cast("bigint").alias("n"), mean.alias("mean"), m2.alias("m2"))


def block_of(day: dt.date) -> int:
    return (day - EPOCH).days // BLOCK_DAYS


class DailySeries:
    """The series below ``path``, from ``first_day`` on; lines of earlier days are not read."""

    def __init__(self, spark: SparkSession, path: str, first_day: dt.date):
        self.spark, self.path, self.first_day = spark, path.rstrip("/"), first_day

    def _covered(self, lines: DataFrame, slack: int) -> DataFrame:
        early = self.first_day - dt.timedelta(days=slack)
        return lines.filter((F.col("ingest_date") >= day_lit(early)) & (usage_day() >= day_lit(self.first_day)))

    def landed(self, lines: DataFrame, path: str, until: dt.datetime, slack: int = 1) -> DataFrame:
        """The lines of runs up to ``until``, with the columns of the series, written by ingestion day and read again."""
        kept = _exported(regular_only(self._covered(lines, slack)), until, slack).select(*LANDED)
        overwrite_partitions(kept, path, "ingest_date")
        return self.spark.read.schema(kept.schema).parquet(path)

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return self.spark.createDataFrame([], schema)

    def days(self) -> DataFrame:
        """``usage_date, project_id, service, net_cost, stated_at``: the cost of each day as last stated."""
        return self._table("days", DAYS)

    def blocks(self) -> DataFrame:
        return self._table("blocks", BLOCKS)

    def last_run(self) -> dt.datetime | None:
        return self._table("runs", RUNS).agg(F.max("until")).first()[0]

    def update(self, lines: DataFrame, until: dt.datetime, since: dt.datetime | None = None, slack: int = 1) -> list[dt.date]:
        """Restate the days touched by lines exported since the last run; returns those days.

        Before the first run all covered lines up to ``until`` count, or those after ``since`` where a stream has
        filled the series.  The list has at most one entry for each day of the history.  A run that is
        repeated finds nothing new and changes nothing.
        """
        since, lines = self.last_run() or since, self._covered(lines, slack)
        if since is not None and since >= until:
            return []
        days = sorted(r[0] for r in changed_days(lines, since, until, slack).collect())
        if days:
            self.replace(daily_cost(lines_of_days(lines, days, until, slack)).withColumn("stated_at", ts_lit(until)), days)
        run = self.spark.createDataFrame([(since, len(days), until)], RUNS)
        overwrite_partitions(run, f"{self.path}/runs", "until")
        return days

    def replace(self, stated: DataFrame, days: list[dt.date]) -> None:
        """Put whole days, which ``stated`` has, in the place of the stored ones."""
        overwrite_partitions(stated.select("project_id", "service", "net_cost", "stated_at", "usage_date"), f"{self.path}/days", "usage_date")
        self._update_blocks(days)

    def _update_blocks(self, days: list[dt.date]) -> None:
        """The blocks of ``days`` from their stored days; no other day is read."""
        numbers = sorted({block_of(d) for d in days})
        whole = [EPOCH + dt.timedelta(days=b * BLOCK_DAYS + i) for b in numbers for i in range(BLOCK_DAYS)]
        inside = None
        for first, last in day_ranges(whole):
            near = F.col("usage_date").between(day_lit(first), day_lit(last))
            inside = near if inside is None else inside | near
        block = F.floor(F.unix_date("usage_date") / BLOCK_DAYS).cast("int")
        x = F.col("net_cost").cast("double")
        chosen = self.days().filter(inside).select(*KEYS, block.alias("block"), _moments(F.lit(1), x, F.lit(0.0)).alias("one"))
        known = self.spark.createDataFrame([(b,) for b in numbers], "block int")
        # At most ``BLOCK_DAYS`` values for a key.
        pieces = chosen.join(F.broadcast(known), "block", "left_semi").groupBy("block", *KEYS).agg(F.sort_array(F.collect_list("one")).alias("p"))
        table = pieces.select(*KEYS, merged(F.col("p")).alias("m"), "block").select(*KEYS, "m.n", "m.mean", "m.m2", "block")
        overwrite_partitions(table, f"{self.path}/blocks", "block")

    def moments(self, first: dt.date, last: dt.date) -> DataFrame:
        """``project_id, service, moments`` over all days from ``first`` to ``last``; a day without cost is a 0."""
        total = (last - first).days + 1
        blocks = [b for b in range(block_of(first), block_of(last) + 1) if EPOCH + dt.timedelta(days=b * BLOCK_DAYS) >= first and EPOCH + dt.timedelta(days=(b + 1) * BLOCK_DAYS - 1) <= last]
        if blocks:
            inner = (EPOCH + dt.timedelta(days=blocks[0] * BLOCK_DAYS), EPOCH + dt.timedelta(days=(blocks[-1] + 1) * BLOCK_DAYS - 1))
            edges = [(first, inner[0] - dt.timedelta(days=1)), (inner[1] + dt.timedelta(days=1), last)]
        else:
            edges = [(first, last)]
        singles = [a + dt.timedelta(days=i) for a, b in edges for i in range((b - a).days + 1)]
        x = F.col("net_cost").cast("double")
        single = self.days().filter(F.col("usage_date").isin(singles)).select(*KEYS, _moments(F.lit(1), x, F.lit(0.0)).alias("piece"))
        block = self.blocks().filter(F.col("block").isin(blocks)).select(*KEYS, _moments(F.col("n"), F.col("mean"), F.col("m2")).alias("piece"))
        # As many pieces as there are blocks and single days; sorted, so that sums do not depend on their order.
        pieces = single.union(block).groupBy(*KEYS).agg(F.sort_array(F.collect_list("piece")).alias("p"))
        found = pieces.withColumn("m", merged(F.col("p")))
        empty = _moments(F.lit(total) - F.col("m.n"), F.lit(0.0), F.lit(0.0)).cast(MOMENTS)
        return found.select(*KEYS, merged(F.array("m", empty)).alias("moments"))

    def anomalies(
        self,
        as_of: dt.date,
        baseline_days: int = 30,
        settle_days: int = 2,
        z_threshold: float = 3.0,
        min_abs_delta: float = 50.0,
        min_n: int = 14,
        flag_zero_variance: bool = False,
    ) -> DataFrame:
        """``anomalies.daily_anomalies`` of the day ``as_of - settle_days``, from the stored series."""
        target = as_of - dt.timedelta(days=settle_days)
        base = self.moments(target - dt.timedelta(days=baseline_days), target - dt.timedelta(days=1))
        today = self.days().filter(F.col("usage_date") == day_lit(target)).select(*KEYS, "net_cost")
        m = F.col("moments")
        scored = today.join(base, KEYS, "full").select(
            day_lit(target).alias("usage_date"),
            *KEYS,
            F.coalesce("net_cost", F.lit(0).cast("decimal(38,10)")).alias("net_cost"),
            F.coalesce(m.mean, F.lit(0.0)).alias("baseline_mean"),
            F.sqrt(F.coalesce(m.m2, F.lit(0.0)) / (baseline_days - 1)).alias("baseline_stddev"),
            F.lit(baseline_days).alias("baseline_n"),
        )
        return verdicts(scored, z_threshold, min_abs_delta, min_n, flag_zero_variance)
