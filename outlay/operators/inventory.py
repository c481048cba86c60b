"""Idle and orphaned resource checks over inventory relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import age_days
from outlay.functions.labels import is_kept, no_users
from outlay.functions.money import fmt_bytes, fmt_money, price
from outlay.functions.template import fill
from outlay.functions.text import machine_vcpus
from outlay.operators.detectors import Context, register, run_all
from outlay.operators.findings import details_json, finding, union_all

HOURS = fixed.HOURS_PER_MONTH


def disk_price(disk_type: Column, prices: dict) -> Column:
    """Monthly price per GB of a disk type; unknown types cost what a balanced disk costs.

    The compute section of the price book becomes one literal map, so no join is needed.
    """
    entries = [F.lit(x) for kv in prices["compute"].items() for x in (kv[0], float(kv[1]))]
    key = F.concat(F.translate(disk_type, "-", "_"), F.lit("_gb_month"))
    return F.coalesce(
        F.try_element_at(F.create_map(*entries), key), price(prices, "compute", "pd_balanced_gb_month")
    )


def sql_tier_monthly(tier: Column, storage_gb: Column, prices: dict) -> Column:
    """Monthly cost of a db-custom-<vcpu>-<MB> tier; other texts count as 2 vCPU and 7.5 GB."""
    parts = F.split(tier, "-")
    vcpu = F.get(parts, F.lit(2)).try_cast("int")
    mem_mb = F.get(parts, F.lit(3)).try_cast("int")
    well_formed = (F.size(parts) == 4) & vcpu.isNotNull() & mem_mb.isNotNull()
    cpus = F.when(well_formed, vcpu.cast("double")).otherwise(2.0)
    mem_gb = F.when(well_formed, mem_mb / 1024.0).otherwise(7.5)
    compute = (
        cpus * price(prices, "cloudsql", "db_custom_vcpu_hour") + mem_gb * price(prices, "cloudsql", "db_custom_gb_hour")
    ) * HOURS
    return compute + storage_gb * price(prices, "cloudsql", "storage_ssd_gb_month")


def _excluded_or(excluded: Column, text: Column, excluded_text: str = fixed.EXCLUDED) -> Column:
    return F.when(excluded, F.lit(excluded_text)).otherwise(text)


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn("excluded", is_kept(F.col("labels")))


def unattached_disks(disks: DataFrame, prices: dict, now: Column) -> DataFrame:
    df = _marked(disks.filter(no_users(F.col("users")))).withColumns(
        {
            "monthly": F.col("size_gb") * disk_price(F.col("type"), prices),
            "idle_days": age_days(F.coalesce("last_attach_timestamp", "creation_timestamp"), now),
        }
    )
    excluded = F.col("excluded")
    snapshot_cost = fmt_money(F.col("size_gb") * price(prices, "compute", "snapshot_gb_month"))
    return finding(
        df,
        "unattached-disk",
        F.concat("zone", F.lit("/disks/"), "name"),
        F.when((F.col("monthly") > 50) & ~excluded, "high").otherwise("medium"),
        F.col("monthly"),
        _excluded_or(
            excluded,
            fill(fixed.DISK_TEXT, days=F.col("idle_days"), cost=snapshot_cost),
            fixed.EXCLUDED_DISK,
        ),
        details_json(
            size_gb=F.col("size_gb"), type=F.col("type"), idle_days=F.col("idle_days"), excluded=excluded, labels=F.col("labels")
        ),
        excluded,
    )


def idle_addresses(addresses: DataFrame, prices: dict, now: Column) -> DataFrame:
    df = _marked(addresses.filter((F.col("status") == "RESERVED") & no_users(F.col("users"))))
    excluded = F.col("excluded")
    return finding(
        df,
        "idle-static-ip",
        F.concat("region", F.lit("/addresses/"), "name"),
        F.lit("low"),
        price(prices, "compute", "static_ip_idle_hour") * HOURS,
        _excluded_or(
            excluded, fill(fixed.ADDRESS_TEXT, address=F.col("address"), days=age_days(F.col("creation_timestamp"), now))
        ),
        details_json(address=F.col("address"), excluded=excluded),
        excluded,
    )


def stopped_instances(instances: DataFrame, prices: dict, now: Column, min_days: int = 14) -> DataFrame:
    """Stopped machines still paying for disks; an unknown stop time counts as 0 days."""
    stopped = F.coalesce(age_days(F.col("last_stop_timestamp"), now), F.lit(0))
    disk_cost = F.aggregate(
        F.coalesce(F.col("disks"), F.array().cast("array<struct<name:string,size_gb:int,type:string>>")),
        F.lit(0.0),
        lambda acc, d: acc + d["size_gb"] * disk_price(d["type"], prices),
    )
    df = _marked(
        instances.filter(F.col("status") == "TERMINATED")
        .withColumn("stopped_days", F.when(F.col("last_stop_timestamp").isNull(), 0).otherwise(stopped))
        .filter(F.col("stopped_days") >= min_days)
    )
    excluded = F.col("excluded")
    return finding(
        df,
        "stopped-vm-with-disks",
        F.concat("zone", F.lit("/instances/"), "name"),
        F.when(excluded, "low").otherwise("medium"),
        disk_cost,
        _excluded_or(excluded, fill(fixed.STOPPED_TEXT, days=F.col("stopped_days"))),
        details_json(machine_type=F.col("machine_type"), stopped_days=F.col("stopped_days"), excluded=excluded),
        excluded,
    )


def old_snapshots(snapshots: DataFrame, prices: dict, now: Column, min_age_days: int = 90) -> DataFrame:
    df = _marked(
        snapshots.withColumn("age", age_days(F.col("creation_timestamp"), now)).filter(F.col("age") >= min_age_days)
    ).withColumn("monthly", F.col("storage_bytes") / float(fixed.GIB) * price(prices, "compute", "snapshot_gb_month"))
    excluded = F.col("excluded")
    return finding(
        df,
        "old-snapshot",
        F.concat(F.lit("snapshots/"), "name"),
        F.when((F.col("monthly") > 10) & ~excluded, "medium").otherwise("low"),
        F.col("monthly"),
        _excluded_or(
            excluded,
            fill(fixed.SNAPSHOT_TEXT, days=F.col("age"), size=fmt_bytes(F.col("storage_bytes"))),
            fixed.EXCLUDED_SNAPSHOT,
        ),
        details_json(age_days=F.col("age"), source_disk=F.col("source_disk"), excluded=excluded),
        excluded,
    )


def empty_node_pools(pools: DataFrame, prices: dict) -> DataFrame:
    """Pools with nodes but no workload pods; an unknown pod count is not a finding."""
    vcpus = machine_vcpus(F.col("machine_type"))
    node = (
        vcpus * price(prices, "compute", "e2_vcpu_hour") + (vcpus * 4) * price(prices, "compute", "e2_gb_hour")
    ) * HOURS
    spot_factor = 1 - float(prices["compute"]["spot_discount_fraction"])
    node = F.when(F.coalesce("spot", F.lit(False)), node * spot_factor).otherwise(node)
    df = pools.filter(
        (F.coalesce("node_count", F.lit(0)) != 0) & (F.coalesce("running_pods_excluding_daemonsets", F.lit(1)) == 0)
    )
    return finding(
        df,
        "empty-node-pool",
        F.concat("cluster", F.lit("/nodePools/"), "name"),
        F.lit("high"),
        node * F.col("node_count"),
        F.lit(fixed.POOL_TEXT),
        details_json(node_count=F.col("node_count"), machine_type=F.col("machine_type"), autoscaling=F.col("autoscaling")),
    )


def lbs_without_backends(rules: DataFrame, prices: dict) -> DataFrame:
    healthy = F.coalesce("backend_service_healthy_backends", F.lit(1))
    total = F.coalesce("backends_total", F.lit(0))
    return finding(
        rules.filter((healthy <= 0) & (total <= 0)),
        "lb-no-backends",
        F.concat("region", F.lit("/forwardingRules/"), "name"),
        F.lit("medium"),
        price(prices, "compute", "forwarding_rule_hour") * HOURS,
        F.lit(fixed.LB_TEXT),
        details_json(scheme=F.col("load_balancing_scheme"), target=F.col("target")),
    )


def unused_sql(instances: DataFrame, prices: dict, max_connections: int = 1) -> DataFrame:
    df = _marked(
        instances.filter(
            (F.col("state") == "RUNNABLE") & (F.coalesce("connections_p95_14d", F.lit(999)) <= max_connections)
        )
    )
    excluded = F.col("excluded")
    return finding(
        df,
        "unused-cloudsql",
        F.concat("region", F.lit("/sql/"), "name"),
        F.when(excluded, "low").otherwise("high"),
        sql_tier_monthly(F.col("tier"), F.col("storage_gb"), prices),
        _excluded_or(excluded, fill(fixed.SQL_TEXT, connections=F.col("connections_p95_14d"))),
        details_json(tier=F.col("tier"), cpu_avg_14d=F.col("cpu_utilization_avg_14d"), excluded=excluded),
        excluded,
    )


@register("unattached_disks", ("disks",))
def _(disks: DataFrame, context: Context) -> DataFrame:
    return unattached_disks(disks, context.prices, context.now)


@register("idle_addresses", ("addresses",))
def _(addresses: DataFrame, context: Context) -> DataFrame:
    return idle_addresses(addresses, context.prices, context.now)


@register("stopped_instances", ("instances",))
def _(instances: DataFrame, context: Context) -> DataFrame:
    return stopped_instances(instances, context.prices, context.now, context.option("min_stopped_days", 14))


@register("old_snapshots", ("snapshots",))
def _(snapshots: DataFrame, context: Context) -> DataFrame:
    return old_snapshots(snapshots, context.prices, context.now, context.option("min_snapshot_age_days", 90))


@register("empty_node_pools", ("node_pools",))
def _(node_pools: DataFrame, context: Context) -> DataFrame:
    return empty_node_pools(node_pools, context.prices)


@register("lbs_without_backends", ("forwarding_rules",))
def _(forwarding_rules: DataFrame, context: Context) -> DataFrame:
    return lbs_without_backends(forwarding_rules, context.prices)


@register("unused_sql", ("cloudsql_instances",))
def _(instances: DataFrame, context: Context) -> DataFrame:
    return unused_sql(instances, context.prices, context.option("max_sql_connections", 1))


def analyze(inv: dict[str, DataFrame], prices: dict, now: Column, extra: list[DataFrame] | None = None, **options: int) -> DataFrame:
    """Union of the findings of all registered detectors; ``extra`` takes further findings relations.

    Options of the built-in ones: ``min_snapshot_age_days`` (90), ``min_stopped_days`` (14) and
    ``max_sql_connections`` (1); further ones reach the detectors through their context.
    """
    return union_all([*run_all(inv, Context(prices, now, options)), *(extra or [])])
