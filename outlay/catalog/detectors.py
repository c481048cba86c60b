"""Rightsizing, warehouse, storage, cache and summary queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay import fixed
from outlay.binding import tables as b
from outlay.functions.dates import ts_lit
from outlay.functions.money import round_up, rounded
from outlay.functions.text import workload_of_pod
from outlay.operators import cache, inventory, rightsizing, storage, summary, warehouse
from outlay.sources import documents

P = fixed.DEFAULT_PRICES
QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def recommendations(spark, sf, **kw):
    return rightsizing.recommend(b.container_usage(spark, sf), P, **kw)


def _joined_notes(df):
    return df.withColumn("notes", F.concat_ws(" | ", "notes"))


@query("K1a_workload_of_pod")
def _(spark, sf):
    pods = b.samples(spark, sf).filter(F.col("metric") == fixed.M_CPU_USAGE).select("pod").distinct()
    return pods.select("pod", workload_of_pod(F.col("pod")).alias("workload"))


@query("K2_recommendations")
def _(spark, sf):
    return _joined_notes(recommendations(spark, sf))


@query("K2_recommendations_with_limits")
def _(spark, sf):
    return _joined_notes(recommendations(spark, sf, cpu_limits="2x"))


@query("K2a_round_up")
def _(spark, sf):
    usage = b.container_usage(spark, sf)
    return usage.select(
        *rightsizing.KEYS, round_up(F.col("cpu_p95_m"), 50).alias("cpu_step"), round_up(F.col("mem_p99_mi"), 32).alias("mem_step")
    )


@query("K2b_request_deltas")
def _(spark, sf):
    return rightsizing.with_deltas(recommendations(spark, sf)).select(*rightsizing.KEYS, "cpu_delta_cores", "mem_delta_gib")


@query("K3_vpa_comparison")
def _(spark, sf):
    recs = rightsizing.attach_vpa(recommendations(spark, sf), b.vpa_targets(spark, sf))
    return _joined_notes(recs).select(*rightsizing.KEYS, "rec_cpu_request_m", "vpa_target_cpu_m", "vpa_target_mem_mi", "notes")


@query("K4_sorted_recommendations")
def _(spark, sf):
    recs = rightsizing.sort_recommendations(recommendations(spark, sf))
    return recs.select(*rightsizing.KEYS, rightsizing.status_rank(F.col("status")).alias("status_rank"), "monthly_delta_estimate")


@query("K5_rightsizing_summary")
def _(spark, sf):
    return rightsizing.summary(recommendations(spark, sf))


@query("K6_patch_documents")
def _(spark, sf):
    return rightsizing.patch_docs(recommendations(spark, sf))


@query("D8_quota_sizing")
def _(spark, sf):
    return rightsizing.quota_sizing(recommendations(spark, sf), b.quotas(spark, sf))


@query("D12_range_conformance")
def _(spark, sf):
    return rightsizing.conformance(b.container_specs(spark, sf), b.limit_ranges(spark, sf))


# ------------------------------------------------------------------ warehouse
@query("Q1_query_rollup")
def _(spark, sf):
    rolled = warehouse.query_rollup(b.job_log(spark, sf), b.NOW)
    return rolled.withColumn("avg_duration_s", rounded(F.col("avg_duration_s"), 4))


@query("SRC6_query_log_rollup")
def _(spark, sf):
    """The rollup without a top bound: every query group of the window."""
    rolled = warehouse.query_rollup(b.job_log(spark, sf), b.NOW, top=None)
    return rolled.select("query_hash", "label_team", "run_count", "total_bytes_billed", "total_slot_ms", "user_email")


@query("Q2_on_demand_cost")
def _(spark, sf):
    cost = warehouse.on_demand_cost(F.col("total_bytes_billed"), P)
    return b.query_jobs(spark, sf).select("query_hash", rounded(cost, 4).alias("on_demand_cost"))


@query("Q3_expensive_queries")
def _(spark, sf):
    return warehouse.expensive_queries(b.query_jobs(spark, sf), P)


@query("Q4_scan_attribution")
def _(spark, sf):
    return warehouse.scan_attribution(b.query_jobs(spark, sf))


@query("Q5_table_layout")
def _(spark, sf):
    return warehouse.table_layout(b.warehouse_tables(spark, sf), b.query_jobs(spark, sf), P)


@query("Q5a_temporal_columns")
def _(spark, sf):
    from outlay.functions.text import looks_temporal

    cols = F.coalesce("typical_filter_columns", F.array().cast("array<string>"))
    date_col = F.get(F.filter(cols, looks_temporal), F.lit(0))
    return b.warehouse_tables(spark, sf).select(
        "table", date_col.alias("date_column"), F.concat_ws(",", F.filter(cols, lambda c: ~looks_temporal(c))).alias("other_columns")
    )


@query("Q6_partition_expiration")
def _(spark, sf):
    return warehouse.partition_expiration(b.warehouse_tables(spark, sf), P)


@query("Q7_long_term_storage")
def _(spark, sf):
    return warehouse.long_term_candidates(b.warehouse_tables(spark, sf), P)


@query("Q8_slot_breakeven")
def _(spark, sf):
    return warehouse.slot_breakeven(b.query_jobs(spark, sf), P)


@query("Q9_suggested_ddl")
def _(spark, sf):
    found = warehouse.analyze(b.query_jobs(spark, sf), b.warehouse_tables(spark, sf), P)
    return warehouse.suggested_ddl(found)


@query("Q10_top_users")
def _(spark, sf):
    return warehouse.top_users(b.job_log(spark, sf), b.NOW)


@query("Q11_unguarded_tables")
def _(spark, sf):
    return warehouse.unguarded_tables(b.warehouse_tables(spark, sf))


@query("Q12_storage_billing")
def _(spark, sf):
    return warehouse.storage_billing(b.warehouse_tables(spark, sf), P, physical_gb_month=0.046)


# ------------------------------------------------------------------ storage
def plans(spark, sf):
    return storage.bucket_plans(b.buckets(spark, sf), P)


@query("G1_band_class_plan")
def _(spark, sf):
    return b.buckets(spark, sf).select("name", F.inline(storage.band_class_plan(F.col("access_pattern"))))


@query("G2_storage_cost")
def _(spark, sf):
    return storage.class_band_cost(b.buckets(spark, sf), P)


@query("G3_bucket_plans")
def _(spark, sf):
    return plans(spark, sf).withColumns({"rules": F.size("rules"), "notes": F.concat_ws(" | ", "notes")})


@query("G3a_lifecycle_rules")
def _(spark, sf):
    return plans(spark, sf).filter(F.size("rules") > 0).select("bucket", storage.rules_json(F.col("rules")).alias("lifecycle"))


@query("G4_bucket_findings")
def _(spark, sf):
    return storage.bucket_findings(plans(spark, sf))


@query("G5_total_saving")
def _(spark, sf):
    return storage.total_saving(plans(spark, sf))


@query("G6_age_bands")
def _(spark, sf):
    return storage.age_bands(b.objects(spark, sf), b.AS_OF)


@query("G7_unit_prices")
def _(spark, sf):
    """Unit prices next to the bytes held in each class."""
    held = b.objects(spark, sf).groupBy(F.col("storage_class").alias("class")).agg(F.sum("size_bytes").alias("bytes"))
    return held.join(F.broadcast(storage.unit_prices(documents.load_prices(spark))), "class")


@query("D10_class_mix")
def _(spark, sf):
    return storage.class_mix(b.objects(spark, sf), b.AS_OF)


# ------------------------------------------------------------------ cache
def cache_plans(spark, sf):
    return cache.capacity_plan(b.cache_config(spark, sf), b.cache_samples(spark, sf), P)


@query("R1_growth")
def _(spark, sf):
    return cache.growth(b.cache_samples(spark, sf)).select(
        "instance", "n", "span_days", rounded(F.col("growth_per_day"), 6).alias("growth_per_day"), rounded(F.col("current_gib"), 6).alias("current_gib")
    )


@query("R2_capacity_plan")
def _(spark, sf):
    return cache_plans(spark, sf).withColumn("actions", F.size("actions"))


@query("R2a_size_step")
def _(spark, sf):
    need = F.col("used_memory") / cache.GIB * 1.25
    return b.cache_samples(spark, sf).select("instance", "date", cache.size_step(need).alias("size_gb"))


@query("R3_actions")
def _(spark, sf):
    return cache_plans(spark, sf).select("instance", F.posexplode("actions").alias("position", "action"))


@query("R4_eviction_policy")
def _(spark, sf):
    return b.cache_config(spark, sf).select(
        "instance", cache.eviction_policy(F.col("ttl_coverage_ratio"), F.col("tier")).alias("policy")
    )


@query("R5_shards")
def _(spark, sf):
    total, by_memory, by_ops = cache.shards(F.col("provisioned_memory_gb") * 1.25, F.col("ops_per_sec_p95").cast("double"))
    return b.cache_config(spark, sf).select(
        "instance", total.alias("shards"), by_memory.alias("by_memory"), by_ops.alias("by_ops")
    )


@query("R6_gb_hour_rate")
def _(spark, sf):
    gb = F.col("provisioned_memory_gb").cast("double")
    rate = cache.gb_hour(gb, F.col("tier"), P)
    return b.cache_config(spark, sf).select(
        "instance", rate.alias("rate"), rounded(gb * rate * fixed.HOURS_PER_MONTH).alias("monthly")
    )


@query("R7_memory_trend")
def _(spark, sf):
    return cache.memory_trend(b.cache_samples(spark, sf))


@query("D11_fragmentation")
def _(spark, sf):
    return cache.fragmentation(b.cache_samples(spark, sf), threshold=1.25)


@query("M1_run_summary")
def _(spark, sf):
    jobs, tables = b.query_jobs(spark, sf), b.warehouse_tables(spark, sf)
    return summary.run_summary(
        inventory.analyze(b.inventory(spark, sf), P, ts_lit(b.NOW)),
        recommendations(spark, sf),
        warehouse.analyze(jobs, tables, P),
        warehouse.slot_breakeven(jobs, P),
        plans(spark, sf),
        cache_plans(spark, sf),
    )
