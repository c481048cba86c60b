"""Streaming rollup, alerts and metric alignment.

Every function from a stream to a stream also works on a static DataFrame, apart from the
watermark.  Streams run with ``availableNow`` over files or continuously over any source.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from outlay import fixed
from outlay.operators.billing import service_name, line_net, project_or_account
from outlay.operators.metrics import ALIGNERS, REDUCERS
from outlay.operators.series import DailySeries
from outlay.plans.budgets import budget_alerts
from outlay.sources.billing import regular_only
from outlay.streaming.fired import FiredAlerts

LATE = "3 days"
# More than the longest month and less than the two shortest ones together.
MONTH_LATE = "32 days"


def _priced(lines: DataFrame, late: str) -> DataFrame:
    # Watermarks need a TIMESTAMP; sessions run in UTC.
    return (
        regular_only(lines)
        .withColumn("usage_start_time", F.col("usage_start_time").cast("timestamp"))
        .withWatermark("usage_start_time", late)
        .select(
            "usage_start_time", project_or_account().alias("project_id"), service_name().alias("service"), line_net().alias("net")
        )
    )


def daily_sums(lines: DataFrame, late: str = LATE) -> DataFrame:
    """Exact net cost per day window, project and service; a day is emitted once no row of it is awaited."""
    day = F.window("usage_start_time", "1 day")
    return _priced(lines, late).groupBy(day.alias("day"), "project_id", "service").agg(F.sum("net").alias("net"))


def daily_rollup(lines: DataFrame, late: str = LATE) -> DataFrame:
    """``daily_sums`` in report precision.

    Rows later than ``late`` are dropped here and picked up by restating the day in batch
    (``start_series`` and ``DailySeries.update``).
    """
    return daily_sums(lines, late).select(
        F.to_date("day.start").alias("usage_date"), "project_id", "service", F.round("net", 2).cast("double").alias("net_cost")
    )


def spend_alerts(lines: DataFrame, threshold: float = fixed.DAILY_SPEND_ALERT, late: str = LATE) -> DataFrame:
    """Projects whose cost of a day is above the threshold, for update mode: as soon as it is.

    The watermark bounds the state to the days that may still change.
    """
    day = F.window("usage_start_time", "1 day")
    grouped = _priced(lines, late).groupBy(day.alias("day"), "project_id").agg(F.sum("net").alias("net"))
    return grouped.filter(F.col("net") > threshold).select(
        F.to_date("day.start").alias("usage_date"), "project_id", F.round("net", 2).cast("double").alias("net_cost")
    )


def align_reduce_stream(
    points: DataFrame,
    period_seconds: int,
    aligner: str,
    reducer: str,
    series: list[str],
    group_by: list[str],
    late: str = "10 minutes",
) -> DataFrame:
    """Tumbling alignment per series, then reduction per group, both on event time."""
    period = f"{period_seconds} seconds"
    aligned = (
        points.withWatermark("ts", late)
        .groupBy(*dict.fromkeys([*series, *group_by]), F.window("ts", period).alias("w"))
        .agg(ALIGNERS[aligner](F.col("value"), period_seconds).alias("value"))
        .select(*group_by, F.window_time("w").alias("ts"), "value")
    )
    reduced = aligned.groupBy(*group_by, F.window("ts", period).alias("w")).agg(REDUCERS[reducer]("value").alias("value"))
    return reduced.select(*group_by, F.col("w.start").alias("period"), "value")


COUNTER_STATE = "rows binary"
# Series share the groups of the state: enough of them for all cores, and few beside the series.
COUNTER_GROUPS = 1024


def counter_rate_stream(
    samples: DataFrame,
    keys: list[str],
    seconds: int = 300,
    late: str = "10 minutes",
    max_gap: dt.timedelta | None = None,
    groups: int = COUNTER_GROUPS,
) -> DataFrame:
    """``metrics.counter_rate`` on a stream: per-second rate per series and closed cell, for append mode.

    The state of a series is the newest closed cell with its last value, from which the step into the next
    one is taken, and the scrapes the watermark has not closed yet: those of ``late`` and a cell. Gaps and
    resets count as in batch; scrapes of closed cells are dropped. A group of the state holds the series of one
    hash, which are stepped together; ``groups`` has to stay the same for one checkpoint and grows with the series.
    """
    width = seconds * 1_000_000
    gap = 2 * width if max_gap is None else int(max_gap.total_seconds() * 1_000_000)
    series = ["metric", *keys]
    columns = [*series, "us", "value"]

    def stepped(rows: pd.DataFrame, closed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Increases of the cells of many series that are closed, and the rows to keep.

        ``rows`` are scrapes (``us, value, carried`` false) and for each series its newest closed cell with its last
        value, if there is one (``us`` is the cell, ``carried`` true).
        """
        rows = rows.assign(series=rows.groupby(series, dropna=False, sort=False).ngroup()).sort_values(["series", "us", "value"], ignore_index=True)
        done = (rows["us"] // width * width + width <= closed) | rows["carried"]
        left, rows = rows[~done], rows[done].reset_index(drop=True)
        if not len(rows):
            return rows.assign(grid=rows["us"], increase=rows["value"]), left
        code, value, carried = (rows[c].to_numpy() for c in ("series", "value", "carried"))
        grid = rows["us"].to_numpy() // width * width
        same = np.concatenate([[False], code[1:] == code[:-1]])
        begins = ~same | np.concatenate([[True], grid[1:] != grid[:-1]])
        was, since = np.roll(value, 1), grid - np.roll(grid, 1)
        far = begins & same & (since > gap)
        rise = np.where(same & ~far, np.where(value < was, value, value - was), 0.0)
        starts = np.flatnonzero(begins)
        scrapes = np.diff([*starts, len(rows)])
        cells = rows.iloc[starts].assign(grid=grid[starts], increase=np.add.reduceat(rise, starts))
        # A cell behind too long a gap has no increase of its own if it has a single scrape.
        cells = cells[~carried[starts] & ~(far[starts] & (scrapes == 1))]
        newest = rows.groupby("series", sort=False).tail(1)
        newest = newest.assign(us=newest["us"] // width * width, carried=True)
        return cells, pd.concat([newest, left])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = state.getCurrentWatermarkMs() * 1000
        parts = [pa.ipc.open_stream(state.get[0]).read_all().to_pandas()] if state.exists else []
        for frame in frames:
            fresh = frame.loc[frame["us"] // width * width + width > closed, columns]
            parts.append(fresh.assign(carried=False))
        rows = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        cells, kept = stepped(rows, closed)
        kept = pa.Table.from_pandas(kept[[*columns, "carried"]], schema=stored, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, stored) as writer:
            writer.write_table(kept)
        state.update((sink.getvalue().to_pybytes(),))
        waiting = kept.filter(pc.invert(kept["carried"]))["us"]
        if len(waiting):
            state.setTimeoutTimestamp(max(pc.min(waiting).as_py() // width * width + width, closed + 1000) // 1000)
        yield cells.assign(value=cells["increase"] / seconds)[[*series, "grid", "value"]]

    scrapes = samples.filter(F.col("value").isNotNull()).withWatermark("ts", late)
    scrapes = scrapes.select(F.pmod(F.xxhash64(*series), F.lit(groups)).alias("group"), *series, "ts", F.unix_micros("ts").alias("us"), "value")
    kept_schema = T.StructType([*[scrapes.schema[c] for c in columns], T.StructField("carried", T.BooleanType())])
    stored = to_arrow_schema(kept_schema)
    schema = T.StructType([*[scrapes.schema[c] for c in series], T.StructField("grid", T.LongType()), T.StructField("value", T.DoubleType())])
    rates = scrapes.groupBy("group").applyInPandasWithState(step, schema, COUNTER_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return rates.select(*series, F.timestamp_micros("grid").alias("grid"), "value")


def month_spend(lines: DataFrame, late: str = MONTH_LATE) -> DataFrame:
    """Running spend per month and project with its linear forecast, for update mode.

    The state is one row per project and month.  The watermark lies on the end of the month: a month
    stays open while lines of it or of the next one arrive, and its state goes with the first lines of the
    month after.  Later ones are left to restatement.
    """
    start = F.col("usage_start_time")
    sums = (
        regular_only(lines)
        .select(
            F.date_add(F.last_day(start), 1).cast("timestamp").alias("month_end"),
            project_or_account().alias("project_id"),
            F.to_date(start).alias("day"),
            line_net().alias("net"),
        )
        .withWatermark("month_end", late)
        .groupBy("month_end", "project_id")
        .agg(F.sum("net").alias("actual"), F.max("day").alias("last_day"))
    )
    days = F.day(F.last_day("last_day"))
    return sums.select(
        F.date_format("last_day", "yyyyMM").alias("month"),
        "project_id",
        "actual",
        (F.col("actual").cast("double") / F.day("last_day") * days).alias("forecast"),
    )


def start_append(df: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append closed windows to Parquet; the file sink commits each batch exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)


def start_series(lines: DataFrame, series: DailySeries, checkpoint: str, late: str = LATE) -> StreamingQuery:
    """Closed days of the stream into the daily series, which batch runs then restate.

    All keys of a day close in one batch, so each batch replaces whole days and may be repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The days that close in one batch.
        days = sorted(r[0] for r in batch.select(F.to_date("day.start")).distinct().collect())
        if days:
            stated = batch.select(
                "project_id", "service", F.col("net").cast("decimal(38,10)").alias("net_cost"), F.col("day.end").cast("timestamp_ntz").alias("stated_at"), F.to_date("day.start").alias("usage_date")
            )
            series.replace(stated, days)

    sums = daily_sums(lines, late)
    return sums.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _start_alerts(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def start_alerts(df: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("usage_date", "project_id")) -> StreamingQuery:
    """Fire each alert once, in the batch that crosses the limit; the first key is the alert's day."""
    return _start_alerts(df, FiredAlerts(path, df.schema, keys, F.date_format(keys[0], "yyyyMM")).write, checkpoint)


def start_budget_alerts(spark: SparkSession, lines: DataFrame, budget: float, path: str, checkpoint: str, late: str = MONTH_LATE) -> StreamingQuery:
    """Fire each (month, project, basis, threshold) once."""
    spend = month_spend(lines, late)
    keys = ("month", "project_id", "basis", "threshold")
    fired = FiredAlerts(path, budget_alerts(spend, budget).schema, keys, F.col("month"))
    return _start_alerts(spend, lambda batch, batch_id: fired.write(budget_alerts(batch, budget), batch_id), checkpoint)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
