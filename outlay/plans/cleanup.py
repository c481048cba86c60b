"""Cleanup and schedule plans: what would be done, step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.labels import map_label, no_users
from outlay.operators.findings import union_all

PLAN, SKIP, REFUSE = "PLAN", "SKIP", "REFUSE"


def _cutoff(now: Column, min_age_days: int) -> Column:
    return now - F.make_dt_interval(F.lit(min_age_days))


def _kept(labels: Column, exclude: str) -> Column:
    """Exact match of the exclusion label, given as key=value."""
    key, _, value = exclude.partition("=")
    return F.coalesce(map_label(labels, key) == F.lit(value), F.lit(False))


def _steps(kept: Column, steps: list[Column]) -> Column:
    skipped = F.array(F.struct(F.lit(0).alias("step"), F.lit("skip").alias("action")))
    planned = F.array(
        *[F.struct(F.lit(i).alias("step"), s.alias("action")) for i, s in enumerate(steps, start=1)]
    )
    return F.inline(F.when(kept, skipped).otherwise(planned))


def _plan(df: DataFrame, kind: str, scope: Column, kept: Column, steps: list[Column]) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        F.col("name").alias("resource"),
        scope.alias("scope"),
        F.when(kept, SKIP).otherwise(PLAN).alias("decision"),
        _steps(kept, steps),
    )


def disk_plan(
    disks: DataFrame, now: Column, min_age_days: int = 30, exclude: str = "keep=true", snapshot_first: bool = True
) -> DataFrame:
    """Disks without users, detached (or, never detached, created) before the cut-off."""
    old = F.coalesce("last_detach_timestamp", "creation_timestamp") < _cutoff(now, min_age_days)
    snapshot = F.concat(F.lit("snapshot pre-delete-"), "name", F.lit("-"), F.date_format(now, "yyyyMMdd"))
    steps = ([snapshot] if snapshot_first else []) + [F.lit("delete")]
    return _plan(
        disks.filter(no_users(F.col("users")) & old), "disk", F.col("zone"), _kept(F.col("labels"), exclude), steps
    )


def snapshot_plan(snapshots: DataFrame, now: Column, min_age_days: int = 30, exclude: str = "keep=true") -> DataFrame:
    """Snapshots older than the cut-off, except those the cleanup itself made."""
    own = F.coalesce(map_label(F.col("labels"), "source") == "cleanup", F.lit(False))
    old = F.col("creation_timestamp") < _cutoff(now, min_age_days)
    return _plan(
        snapshots.filter(old & ~own), "snapshot", F.lit("global"), _kept(F.col("labels"), exclude), [F.lit("delete")]
    )


def address_plan(addresses: DataFrame, now: Column, min_age_days: int = 30, exclude: str = "keep=true") -> DataFrame:
    """Reserved addresses older than the cut-off, with a global or a regional scope."""
    old = F.col("creation_timestamp") < _cutoff(now, min_age_days)
    region = F.coalesce("region", F.lit(""))
    scope = F.when(region.isin("", "global"), "global").otherwise(region)
    return _plan(
        addresses.filter((F.col("status") == "RESERVED") & old),
        "address",
        scope,
        _kept(F.col("labels"), exclude),
        [F.lit("delete")],
    )


def combined_plan(inv: dict[str, DataFrame], now: Column, only: str | None = None, **options) -> DataFrame:
    """All plans, or the one named by ``only`` (disks, snapshots or addresses)."""
    makers = {"disks": disk_plan, "snapshots": snapshot_plan, "addresses": address_plan}
    if only is not None and only not in makers:
        raise ValueError("only must be disks, snapshots or addresses")
    chosen = {k: m for k, m in makers.items() if only in (None, k)}
    disk_only = {k: options.pop(k) for k in ("snapshot_first",) if k in options}
    return union_all(
        [m(inv[k], now, **options, **(disk_only if k == "disks" else {})) for k, m in chosen.items()]
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """Resources per kind and decision; a resource counts once however many steps it has."""
    return plan.groupBy("kind", "decision").agg(F.count_if(F.col("step") <= 1).alias("resources"))


def schedule_plan(pools: DataFrame, action: str, autoscaling: DataFrame | None = None) -> DataFrame:
    """Scale non-production pools down in the evening or up in the morning.

    Anything that looks like production is refused.  ``autoscaling`` tells by project, cluster, location
    and pool, since pool names repeat between clusters, whether the
    autoscaler bounds must move too: 0/0 at night, n/4n by day.
    """
    if action not in ("up", "down"):
        raise ValueError("action must be up or down")
    if autoscaling is None:
        df = pools.withColumn("autoscaling_enabled", F.lit(False))
    else:
        df = pools.join(autoscaling, ["project", "cluster", "location", "pool"], "left")
    refused = F.col("project").contains("prod") | F.col("cluster").contains("prod")
    scaled = F.coalesce("autoscaling_enabled", F.lit(False)) & ~refused
    size = F.lit(0) if action == "down" else F.col("day_count")
    return df.select(
        "project",
        "cluster",
        "location",
        "pool",
        F.when(refused, REFUSE).otherwise(PLAN).alias("decision"),
        F.when(~refused, size).alias("target_nodes"),
        F.when(scaled, size).alias("autoscale_min"),
        F.when(scaled, size * 4).alias("autoscale_max"),
    )
