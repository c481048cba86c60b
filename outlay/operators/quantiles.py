"""Quantiles of series from stored daily sketches.

A KLL sketch summarises the points of a series and day; sketches of days merge into that of a lookback,
with the same error as one sketch over all points.  So fourteen days of a series are fourteen small rows,
however often it was scraped, a late day is replaced on its own, and the raw points are read once.  The table is
partitioned by day: ``day=…`` below one path.

Series of at most ``k`` points are kept whole, and their quantile is the nearest-rank one.  Beyond that the
rank of a result is off by ``rank_error(k)`` at most, in 99 of 100 cases.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions.dates import day_lit
from outlay.sinks import overwrite_partitions

K = 400


def rank_error(k: int = K) -> float:
    """The published error of a KLL sketch, as a share of all points."""
    return 2.296 / k**0.9021


class QuantileStore:
    """Sketches below ``path`` of points ``(metric, *keys, time column, value)``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str = "grid", k: int = K):
        self.spark, self.path, self.time, self.k = spark, path.rstrip("/"), time, k
        self.series = ["metric", *keys]

    def write_days(self, points: DataFrame, first: dt.date, last: dt.date) -> None:
        """Sketch the days from ``first`` to ``last`` anew; other days stay.  NULL and NaN points are left out.

        Points combine on the map side, so a hot series costs one sketch for each task.
        """
        upto = last + dt.timedelta(days=1)
        chosen = points.filter((F.col(self.time) >= day_lit(first)) & (F.col(self.time) < day_lit(upto)) & F.col("value").isNotNull() & ~F.isnan("value"))
        days = chosen.groupBy(*self.series, F.to_date(self.time).alias("day")).agg(
            F.kll_sketch_agg_double("value", F.lit(self.k)).alias("sketch"), F.count("value").alias("n"), F.max("value").alias("highest")
        )
        overwrite_partitions(days.select(*self.series, "sketch", "n", "highest", "day"), self.path, "day")

    def days(self, first: dt.date, last: dt.date) -> DataFrame:
        """The stored sketches of a range of days; only those partitions are read."""
        schema = T.StructType([T.StructField(c, T.StringType()) for c in self.series])
        schema = schema.add("sketch", "binary").add("n", "long").add("highest", "double").add("day", "date")
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.filter(F.col("day").between(day_lit(first), day_lit(last)))

    def quantiles(self, first: dt.date, last: dt.date, **ranks: float) -> DataFrame:
        """The series with ``n`` points, their ``highest`` value and a column for each of ``ranks``."""
        merged = self.days(first, last).groupBy(*self.series).agg(
            F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.max("highest").alias("highest")
        )
        values = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in ranks.items()]
        return merged.select(*self.series, "n", "highest", *values)


def within_rank_error(points: DataFrame, estimates: DataFrame, series: list[str], q: float, name: str, error: float) -> DataFrame:
    """``series`` with ``n`` and ``within``: whether the estimate's rank among the points is ``q`` up to ``error``."""
    x, estimate = F.col("value"), F.col(name)
    counted = points.join(estimates.select(*series, name), series).groupBy(*series, name).agg(
        F.count("*").alias("n"), F.count_if(x < estimate).alias("below"), F.count_if(x <= estimate).alias("upto")
    )
    return counted.select(*series, "n", ((F.col("below") <= (q + error) * F.col("n")) & (F.col("upto") >= (q - error) * F.col("n"))).alias("within"))
