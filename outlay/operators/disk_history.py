"""What disks cost on the days on which they were idle.

The latest version of an asset only tells whether a disk is idle now; a disk that was attached for most of the
window and detached yesterday would be charged with the whole window.  Here the versions become validity
intervals, and the cost of a day counts only if it lies in one.

Versions are first reduced to one row for each disk and day, which combines on the map side and has columns
of fixed width only; so the windows over one disk hold days, however many versions it has.  Costs and
intervals meet on the disk and a bucket of ``BUCKET_DAYS`` days: within a bucket a disk has at most that many
days and half as many intervals, and the intervals of a disk do not overlap, so every cost meets one at most.

A day is idle if no version in force on it lists a user: neither the one it begins with nor those of the day.
Before its first version nothing is known of a disk, so no day is idle.  Versions after ``as_of`` are not read.
Versions without an update time have no place in the history and are left out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import day_lit
from outlay.functions.money import dmoney
from outlay.operators.billing import disk_cost_lines, disk_versions
from outlay.sources.billing import usage_day

BUCKET_DAYS = 8


def day_states(assets: DataFrame, as_of: dt.date) -> DataFrame:
    """``asset_name, day, most, last``: users of a disk at most and at the end of each day with versions."""
    versions = disk_versions(assets.filter((F.col("update_time") < day_lit(as_of + dt.timedelta(days=1))) & F.col("update_time").isNotNull()))
    return (
        versions.select("asset_name", F.to_date("update_time").alias("day"), "version", "attached_count")
        .groupBy("asset_name", "day")
        .agg(F.max("attached_count").alias("most"), F.max_by("attached_count", "version").alias("last"))
    )


def idle_intervals(assets: DataFrame, as_of: dt.date) -> DataFrame:
    """``asset_name, idle_from, idle_to, idle_since``: the longest runs of idle days, ``idle_to`` excluded.

    A run that reaches ``as_of`` ends on the day after it; ``idle_since`` is its first day, on all rows of the disk.
    """
    end = day_lit(as_of + dt.timedelta(days=1))
    disk = Window.partitionBy("asset_name")
    in_order = disk.orderBy("day")
    clear = (F.col("most") == 0) & (F.coalesce(F.lag("last").over(in_order), F.lit(0)) == 0)
    pieces = (
        day_states(assets, as_of)
        .withColumns({"clear": clear, "idle_to": F.coalesce(F.lead("day").over(in_order), end)})
        .withColumn("idle_from", F.when(F.col("clear"), F.col("day")).otherwise(F.date_add("day", 1)))
        .filter((F.col("last") == 0) & (F.col("idle_from") < F.col("idle_to")))
    )
    # Pieces that touch are one run.
    begins = F.lag("idle_to").over(in_order).eqNullSafe(F.col("idle_from"))
    run = F.sum(F.when(F.col("begins"), 0).otherwise(1)).over(in_order)
    runs = (
        pieces.withColumn("begins", begins)
        .withColumn("run", run)
        .groupBy("asset_name", "run")
        .agg(F.min("idle_from").alias("idle_from"), F.max("idle_to").alias("idle_to"))
    )
    since = F.max(F.when(F.col("idle_to") == end, F.col("idle_from"))).over(disk)
    return runs.select("asset_name", "idle_from", "idle_to", since.alias("idle_since"))


def bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS).cast("int")


def idle_disk_cost(lines: DataFrame, assets: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Cost of each disk in the window, of its idle days alone, and since when it is idle (NULL: it is in use)."""
    keys = ["disk_global_name", "disk_name", "project_id", "zone", "sku"]
    daily = disk_cost_lines(lines, as_of, window_days).withColumn("day", usage_day()).groupBy(*keys, "day").agg(F.sum("net").alias("net"))
    first = day_lit(as_of - dt.timedelta(days=window_days))
    # Only names of this form can join; runs are cut to the window before they are laid into buckets.
    runs = idle_intervals(assets.filter(F.col("name").like(fixed.DISK_NAME_LIKE)), as_of).filter(F.col("idle_to") > first)
    cut = runs.withColumn("idle_from", F.greatest("idle_from", first))
    laid = cut.withColumn("bucket", F.explode(F.sequence(bucket(F.col("idle_from")), bucket(F.date_sub("idle_to", 1)))))
    spent = daily.withColumn("at", bucket(F.col("day")))
    on = (spent.disk_global_name == laid.asset_name) & (spent["at"] == laid.bucket) & (spent.day >= laid.idle_from) & (spent.day < laid.idle_to)
    idle = F.col("asset_name").isNotNull()
    return (
        spent.join(laid, on, "left")
        .groupBy(*keys)
        .agg(
            F.sum("net").alias("net"),
            F.sum(F.when(idle, F.col("net"))).alias("idle_net"),
            F.count(F.when(idle, 1)).alias("idle_days"),
            F.max("idle_since").alias("idle_since"),
        )
        .filter(F.col("idle_days") > 0)
        .select(
            "project_id",
            "zone",
            "disk_name",
            "sku",
            dmoney(F.col("net")).alias("net_cost_30d"),
            dmoney(F.col("idle_net")).alias("idle_cost_30d"),
            F.col("idle_days").alias("idle_days_billed"),
            "idle_since",
        )
    )
