"""Inventory, findings, cleanup-plan and document-source queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay import fixed
from outlay.binding import tables as b
from outlay.functions.dates import age_days, ts_lit
from outlay.functions.labels import is_kept
from outlay.functions.money import rounded
from outlay.functions.text import machine_vcpus
from outlay.operators import findings as f
from outlay.operators import inventory as inv
from outlay.plans import cleanup
from outlay.sources import documents

P = fixed.DEFAULT_PRICES
QUERIES = {}


def now():
    return ts_lit(b.NOW)


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def all_findings(spark, sf, **kw):
    return inv.analyze(b.inventory(spark, sf), P, now(), **kw)


@query("I0a_keep_label")
def _(spark, sf):
    return b.disks(spark, sf).select("name", is_kept(F.col("labels")).alias("excluded"))


@query("I0b_disk_price")
def _(spark, sf):
    return b.disks(spark, sf).select("name", "type", inv.disk_price(F.col("type"), P).alias("gb_month"))


@query("I0c_sql_tier_monthly")
def _(spark, sf):
    monthly = inv.sql_tier_monthly(F.col("tier"), F.col("storage_gb"), P)
    return b.cloudsql_instances(spark, sf).select("name", "tier", rounded(monthly).alias("monthly"))


@query("I0d_machine_vcpus")
def _(spark, sf):
    return b.node_pools(spark, sf).select("name", "machine_type", machine_vcpus(F.col("machine_type")).alias("vcpus"))


@query("I0e_age_days")
def _(spark, sf):
    return b.instances(spark, sf).select("name", age_days(F.col("last_stop_timestamp"), now()).alias("age_days"))


@query("I1_unattached_disks")
def _(spark, sf):
    return inv.unattached_disks(b.disks(spark, sf), P, now())


@query("I2_idle_addresses")
def _(spark, sf):
    return inv.idle_addresses(b.addresses(spark, sf), P, now())


@query("I3_stopped_instances")
def _(spark, sf):
    return inv.stopped_instances(b.instances(spark, sf), P, now())


@query("I4_old_snapshots")
def _(spark, sf):
    return inv.old_snapshots(b.snapshots(spark, sf), P, now())


@query("I5_empty_node_pools")
def _(spark, sf):
    return inv.empty_node_pools(b.node_pools(spark, sf), P)


@query("I6_lbs_without_backends")
def _(spark, sf):
    return inv.lbs_without_backends(b.forwarding_rules(spark, sf), P)


@query("I7_unused_sql")
def _(spark, sf):
    return inv.unused_sql(b.cloudsql_instances(spark, sf), P)


@query("I8_all_findings")
def _(spark, sf):
    return all_findings(spark, sf)


@query("I9_sorted_findings")
def _(spark, sf):
    ranked = all_findings(spark, sf).withColumn("severity_rank", f.severity_rank(F.col("severity")))
    return f.sort_findings(ranked)


@query("I10_actionable_split")
def _(spark, sf):
    actionable, excluded = f.split_findings(all_findings(spark, sf))
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "category", "resource", "monthly_cost_estimate")
    return tag(actionable, "actionable").unionByName(tag(excluded, "excluded"))


@query("I11_category_rollup")
def _(spark, sf):
    return f.category_rollup(all_findings(spark, sf))


@query("I12_report_totals")
def _(spark, sf):
    return f.report_totals(all_findings(spark, sf))


@query("D6_findings_delta")
def _(spark, sf):
    """Two runs with different thresholds stand for two weeks."""
    relations = b.inventory(spark, sf)
    before = inv.analyze(relations, P, now(), min_snapshot_age_days=60, max_sql_connections=0)
    dearer = {**P, "compute": {**P["compute"], "pd_ssd_gb_month": 0.3}}
    after = inv.analyze(relations, dearer, now(), min_stopped_days=400)
    return f.findings_delta(before, after)


@query("C1_disk_plan")
def _(spark, sf):
    return cleanup.disk_plan(b.disks(spark, sf), now())


@query("C2_snapshot_plan")
def _(spark, sf):
    return cleanup.snapshot_plan(b.snapshots(spark, sf), now())


@query("C3_address_plan")
def _(spark, sf):
    return cleanup.address_plan(b.addresses(spark, sf), now())


@query("C4_combined_plan")
def _(spark, sf):
    return cleanup.plan_counts(cleanup.combined_plan(b.inventory(spark, sf), now()))


@query("C5_schedule_down")
def _(spark, sf):
    pools = documents.parse_pools(b.pool_config_lines(spark, sf))
    return cleanup.schedule_plan(pools, "down", b.pool_autoscaling(spark, sf))


@query("C5_schedule_up")
def _(spark, sf):
    pools = documents.parse_pools(b.pool_config_lines(spark, sf))
    return cleanup.schedule_plan(pools, "up", b.pool_autoscaling(spark, sf))


@query("SRC4_inventory_documents")
def _(spark, sf):
    """Inventory documents as JSON text, read back into relations."""
    disk = F.struct("name", "zone", "type", "size_gb", "users", "labels")
    docs = b.disks(spark, sf).select(F.to_json(F.struct(F.array(disk).alias("disks"))).alias("value"))
    return documents.parse_inventory(docs)["disks"].select(
        "name", "zone", "type", "size_gb", F.coalesce(F.size("users"), F.lit(0)).alias("n_users"), F.try_element_at("labels", F.lit("keep")).alias("keep")
    )


@query("SRC5_priced_disks")
def _(spark, sf):
    """Price book rows joined to the disks by key; the book is a few dozen rows."""
    book = documents.load_prices(spark).filter(F.col("section") == "compute")
    key = F.concat(F.translate("type", "-", "_"), F.lit("_gb_month"))
    return (
        b.disks(spark, sf)
        .withColumn("key", key)
        .join(F.broadcast(book), "key", "left")
        .groupBy("key", "price")
        .agg(F.count(F.lit(1)).alias("disks"), F.sum("size_gb").alias("size_gb"))
    )


@query("SRC8_flatten_vpa")
def _(spark, sf):
    return documents.flatten_vpa(b.vpa_documents(spark, sf))


@query("SRC9_pool_config")
def _(spark, sf):
    return documents.parse_pools(b.pool_config_lines(spark, sf))
