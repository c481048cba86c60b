"""Cache capacity planning from daily statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.money import fixed_point, fmt_percent, price, ratio, rounded
from outlay.functions.template import fill

GIB = float(fixed.GIB)
BIG_KEY_BYTES = 100 * 1024 * 1024


def growth(samples: DataFrame) -> DataFrame:
    """Least-squares growth in GiB per day, with the latest sample, per instance.

    The slope is per sample and rescaled by the covered days.  An instance has one sample a day,
    so its window stays small however many instances there are.
    """
    by_date = Window.partitionBy("instance").orderBy("date")
    numbered = samples.select(
        "*",
        (F.col("used_memory") / GIB).alias("used_gib"),
        (F.row_number().over(by_date) - 1).cast("double").alias("x"),
    )
    last = F.struct("used_gib", "keyspace_hits", "keyspace_misses", "evicted_keys")
    stats = numbered.groupBy("instance").agg(
        F.regr_slope("used_gib", "x").alias("slope"),
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.lit(1), F.date_diff(F.max("date"), F.min("date"))).alias("span_days"),
        F.max_by(last, "date").alias("last"),
    )
    per_day = F.when(F.col("n") > 1, F.coalesce("slope", F.lit(0.0)) * (F.col("n") - 1) / F.col("span_days"))
    return stats.select(
        "instance",
        "n",
        "span_days",
        F.coalesce(per_day, F.lit(0.0)).alias("growth_per_day"),
        F.col("last.used_gib").alias("current_gib"),
        F.col("last.keyspace_hits").alias("hits"),
        F.col("last.keyspace_misses").alias("misses"),
        F.col("last.evicted_keys").alias("evictions"),
    )


def size_step(need: Column) -> Column:
    """First catalogue size that holds ``need`` GB; beyond the catalogue the next multiple of 50."""
    ladder = F.array(*[F.lit(s) for s in fixed.CACHE_SIZES_GB])
    return F.coalesce(F.array_min(F.filter(ladder, lambda s: s >= need)), (F.ceil(need / 50.0) * 50).cast("int"))


def is_standard(tier: Column) -> Column:
    return F.coalesce(F.upper(tier).startswith("STANDARD"), F.lit(False))


def eviction_policy(ttl: Column, tier: Column) -> Column:
    return F.when(ttl >= 0.9, "volatile-lru").when(is_standard(tier) | (ttl > 0.5), "allkeys-lru").otherwise("allkeys-lfu")


def shards(need: Column, ops: Column) -> tuple[Column, Column, Column]:
    """(total, by memory, by throughput)."""
    by_memory = F.ceil(need / fixed.SHARD_MAX_GB).cast("int")
    by_ops = F.when(ops == 0, 1).otherwise(F.ceil(ops / float(fixed.SHARD_MAX_OPS))).cast("int")
    return F.greatest(F.lit(1), by_memory, by_ops), by_memory, by_ops


def gb_hour(gb: Column, tier: Column, prices: dict) -> Column:
    """Price per GB-hour; the standard tier is cheaper above 35 and above 100 GB."""

    def p(key: str) -> Column:
        return price(prices, "redis", f"memorystore_{key}")

    standard = F.when(gb > 100, p("standard_gb_hour_m5")).when(gb > 35, p("standard_gb_hour_m4")).otherwise(p("standard_gb_hour_m2"))
    return F.when(is_standard(tier), standard).otherwise(p("basic_gb_hour_m2"))


def capacity_plan(
    config: DataFrame, samples: DataFrame, prices: dict, headroom: float = 0.25, horizon_days: int = 90
) -> DataFrame:
    df = config.join(growth(samples), "instance", "inner")
    no_keys = F.array().cast("array<struct<key_pattern:string,count:bigint,avg_bytes:bigint,ttl_set:boolean>>")
    df = df.withColumns(
        {
            "maxmem": F.col("maxmemory_bytes") / GIB,
            "provisioned": F.col("provisioned_memory_gb").cast("double"),
            "ttl": F.coalesce("ttl_coverage_ratio", F.lit(0.0)),
            "ops": F.coalesce("ops_per_sec_p95", F.lit(0)).cast("double"),
            "keys": F.coalesce("big_keys", no_keys),
            "projected": F.col("current_gib") + F.col("growth_per_day") * horizon_days,
            "hit_ratio": F.coalesce(ratio(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(1.0)),
        }
    )
    grows = (F.col("growth_per_day") > 0) & (F.col("current_gib") < F.col("maxmem"))
    df = df.withColumns(
        {
            "need": F.col("projected") * (1 + headroom),
            "days_to_max": F.when(grows, (F.col("maxmem") - F.col("current_gib")) / F.col("growth_per_day")),
        }
    )
    total, by_memory, by_ops = shards(F.col("need"), F.col("ops"))
    df = df.withColumns(
        {"recommended_gb": size_step(F.col("need")), "shards": total, "shards_mem": by_memory, "shards_ops": by_ops}
    )
    tier = F.coalesce("tier", F.lit(""))
    rec = F.col("recommended_gb")
    monthly = lambda gb: gb * gb_hour(gb, tier, prices) * fixed.HOURS_PER_MONTH
    return df.select(
        "instance",
        F.coalesce("provider", F.lit("memorystore")).alias("provider"),
        tier.alias("tier"),
        F.col("provisioned").alias("provisioned_gb"),
        rounded(F.col("maxmem")).alias("maxmemory_gb"),
        rounded(F.col("current_gib")).alias("current_used_gb"),
        rounded(F.coalesce(ratio(F.col("current_gib"), F.col("maxmem")), F.lit(0.0)), 3).alias("utilisation"),
        rounded(F.col("growth_per_day"), 4).alias("growth_gb_per_day"),
        rounded(F.col("days_to_max"), 1).alias("days_to_maxmemory"),
        rounded(F.col("projected")).alias("projected_90d_gb"),
        rounded(F.col("hit_ratio"), 4).alias("hit_ratio"),
        F.col("evictions").alias("evictions_total"),
        F.col("ttl").alias("ttl_coverage"),
        rec.alias("recommended_gb"),
        eviction_policy(F.col("ttl"), tier).alias("recommended_policy"),
        rounded(rec * 0.8, 1).alias("recommended_maxmemory_gb"),
        F.col("shards").alias("recommended_shards"),
        rounded(monthly(F.col("provisioned"))).alias("current_monthly_estimate"),
        rounded(monthly(rec.cast("double"))).alias("recommended_monthly_estimate"),
        actions().alias("actions"),
    )


def actions() -> Column:
    """Action texts over the columns of the plan in progress."""
    days, ttl = F.col("days_to_max"), F.col("ttl")
    heavy = F.filter(
        "keys",
        lambda k: ~F.coalesce(k["ttl_set"], F.lit(False)) & (k["count"] * k["avg_bytes"] / GIB > 0.05),
    )
    key_texts = F.transform(
        heavy,
        lambda k: fill(
            fixed.ACTION_KEYS, pattern=k["key_pattern"], size=fixed_point(k["count"] * k["avg_bytes"] / GIB, 2)
        ),
    )
    first = F.array(
        F.when(
            days < 60,
            fill(
                fixed.ACTION_GROWTH, rate=fixed_point(F.col("growth_per_day") * 1024, 0), days=fixed_point(days, 0)
            ),
        ),
        F.when(
            (F.col("maxmemory_policy") == "noeviction") & (ttl < 0.9),
            fill(fixed.ACTION_NOEVICTION, pct=fmt_percent(1 - ttl)),
        ),
        F.when(F.col("hit_ratio") < 0.8, fill(fixed.ACTION_HITS, pct=fmt_percent(F.col("hit_ratio"), 1))),
    )
    last = F.array(
        F.when(
            F.exists("keys", lambda k: k["avg_bytes"] > BIG_KEY_BYTES),
            F.lit(fixed.ACTION_BIG_KEY),
        ),
        F.when(
            F.col("shards") > 1,
            fill(
                fixed.ACTION_SHARDS, n=F.col("shards"), memory=F.col("shards_mem"), ops=F.col("shards_ops")
            ),
        ),
    )
    return F.array_compact(F.concat(first, key_texts, last))


def memory_trend(samples: DataFrame) -> DataFrame:
    return samples.select(
        "instance",
        "date",
        rounded(F.col("used_memory") / GIB).alias("used_gib"),
        rounded(ratio(F.col("keyspace_hits"), F.col("keyspace_hits") + F.col("keyspace_misses")), 3).alias("hit_ratio"),
    )


def fragmentation(samples: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Allocator fragmentation and whether more keys are evicted than expire."""
    frag = ratio(F.col("used_memory_rss"), F.col("used_memory"))
    return samples.select(
        "instance",
        "date",
        rounded(frag, 3).alias("fragmentation_ratio"),
        F.coalesce(frag > threshold, F.lit(False)).alias("fragmented"),
        "expired_keys",
        "evicted_keys",
        (F.col("evicted_keys") > F.col("expired_keys")).alias("evicts_more_than_expires"),
    )
