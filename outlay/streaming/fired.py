"""Alerts fire once: what has fired is state that stays small to read and survives a lost batch.

The feed is for readers: each batch writes its new alerts as a partition of its own.  Batches do not read it;
they read the state beside it, which is partitioned by the alerts' period (a month) and two slots.  A
slot holds all alerts that have fired for its period up to some batch, so a batch reads the slots of its
own periods only, and there are at most two, however many batches have run.  A batch with new alerts
writes the old and the new ones to the slot that does not hold the newest state.  If it is lost midway the
other slot still has that state, and the repeated batch, which ignores its own first attempt, decides
as it did the first time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.sinks import overwrite_partitions


class FiredAlerts:
    """Feed at ``path`` and state at ``path``-fired of alerts with columns ``schema``.

    ``keys`` name an alert; ``period`` is a text made of them.
    """

    def __init__(self, path: str, schema: T.StructType, keys: tuple[str, ...], period: Column):
        self.feed, self.path = path.rstrip("/"), f"{path.rstrip('/')}-fired"
        self.columns, self.keys, self.period = schema.names, list(keys), period
        self.batch_schema = T.StructType([*schema.fields]).add("period", "string").add("fired_in", "long").add("turn", "integer")
        self.schema = T.StructType([*schema.fields]).add("fired_in", "long").add("version", "long").add("period", "string").add("slot", "integer")

    def _read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return spark.createDataFrame([], schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Period, slot and version of the newest state; slots with equal versions hold the same."""
        best = rows.groupBy("period").agg(F.max("version").alias("version"))
        return rows.join(best, ["period", "version"]).groupBy("period", "version").agg(F.min("slot").alias("slot"))

    def of_periods(self, spark: SparkSession, periods: list, before: int | None = None) -> DataFrame:
        """The stored rows of ``periods``, whose partitions alone are read, without versions from ``before`` on."""
        rows = self._read(spark, "state", self.schema).filter(F.col("period").isin(periods))
        return rows if before is None else rows.filter(F.col("version") < before)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Fire what has not fired yet."""
        spark = batch.sparkSession
        # The batch is computed once; its candidates take turns in two places.
        turn, this = batch_id % 2, F.lit(batch_id).cast("bigint")
        staged = batch.select(*self.columns, self.period.alias("period"), this.alias("fired_in"), F.lit(turn).alias("turn"))
        overwrite_partitions(staged, f"{self.path}/batch", "turn")
        # An empty batch leaves an older one in its place.
        candidates = self._read(spark, "batch", self.batch_schema).filter((F.col("turn") == turn) & (F.col("fired_in") == batch_id)).drop("turn")
        # As many periods as the watermark leaves open.
        periods = [r[0] for r in candidates.select("period").distinct().collect()]
        stored = self.of_periods(spark, periods, batch_id)
        newest = self._newest(stored)
        known = stored.join(newest, ["period", "version", "slot"], "left_semi").drop("version", "slot")
        fresh = candidates.join(known.select(*self.keys), self.keys, "left_anti")
        # A batch without alerts writes no file, and the first one creates the folder.
        if batch_id and (not periods or fresh.isEmpty()):
            return
        overwrite_partitions(fresh.select(*self.columns, F.col("fired_in").alias("batch_id")), self.feed, "batch_id")
        # The state comes last: it replaces files that this batch still reads.
        touched = fresh.select("period").distinct().join(newest.select("period", "slot"), "period", "left")
        target = touched.select("period", (1 - F.coalesce("slot", F.lit(1))).alias("slot"))
        state = known.unionByName(fresh).join(target, "period").withColumn("version", this)
        # A row for each project and threshold of a month: one file.
        overwrite_partitions(state.select(*self.schema.names).repartition(1), f"{self.path}/state", "period", "slot")
