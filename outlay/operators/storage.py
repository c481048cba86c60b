"""Object storage: lifecycle plans per bucket and age bands of object listings.

A bucket has four age bands and four classes, so the regrouping of bands into classes is a few
column expressions per row; a plan needs no shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import calendar_days, day_lit
from outlay.functions.labels import map_label
from outlay.functions.money import fmt_bytes, fmt_money, price, rounded
from outlay.functions.template import fill
from outlay.operators.findings import finding

GB = float(fixed.GB)
CLASSES = fixed.STORAGE_CLASSES
BANDS = fixed.AGE_BANDS


def class_price(prices: dict, cls: str) -> Column:
    return price(prices, "gcs", f"{cls.lower()}_gb_month")


def retrieval_price(prices: dict, cls: str) -> Column:
    return F.lit(0.0) if cls == "STANDARD" else price(prices, "gcs", f"{cls.lower()}_retrieval_gb")


def _by_class(cls: Column, values: dict[str, Column | int]) -> Column:
    out = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cls == name, value) if out is None else out.when(cls == name, value)
    return out


def heat(access: Column) -> Column:
    """hot: heavy reads or egress; warm: median object read within 30 days; else cold."""
    hot = (F.coalesce(access["class_b_ops_30d"], F.lit(0)) > 10_000_000) | (
        F.coalesce(access["egress_gb_30d"], F.lit(0.0)) > 1000
    )
    warm = F.coalesce(access["last_read_age_days_p50"], F.lit(999)) <= 30
    return F.when(hot, "hot").when(warm, "warm").otherwise("cold")


def band_class_plan(access: Column) -> Column:
    """Array of (band, class) by heat."""

    def plan(classes: tuple[str, ...]) -> Column:
        return F.array(*[F.struct(F.lit(b).alias("band"), F.lit(c).alias("class")) for b, c in zip(BANDS, classes)])

    h = heat(access)
    return (
        F.when(h == "hot", plan(fixed.BAND_CLASSES_HOT))
        .when(h == "warm", plan(fixed.BAND_CLASSES_WARM))
        .otherwise(plan(fixed.BAND_CLASSES_COLD))
    )


def _target(h: Column, band: int) -> Column:
    return (
        F.when(h == "hot", fixed.BAND_CLASSES_HOT[band])
        .when(h == "warm", fixed.BAND_CLASSES_WARM[band])
        .otherwise(fixed.BAND_CLASSES_COLD[band])
    )


def ops_cost(access: Column, prices: dict) -> Column:
    a = F.coalesce(access["class_a_ops_30d"], F.lit(0)) / 10_000.0 * price(prices, "gcs", "class_a_ops_per_10k")
    b = F.coalesce(access["class_b_ops_30d"], F.lit(0)) / 10_000.0 * price(prices, "gcs", "class_b_ops_per_10k")
    return a + b


def bucket_plans(
    buckets: DataFrame, prices: dict, noncurrent_days: int = 30, keep_versions: int = 3, guard: bool = False
) -> DataFrame:
    """Current and proposed monthly cost, lifecycle rules and notes per bucket.

    ``guard`` keeps a bucket as it is when modelled retrieval would eat the saving.
    """
    access = F.col("access_pattern")
    current = F.col("storage_class")
    df = buckets.withColumns(
        {
            "heat": heat(access),
            **{f"bytes{i}": F.coalesce(F.try_element_at("age_distribution_bytes", F.lit(b)), F.lit(0)) for i, b in enumerate(BANDS)},
            "noncurrent": F.coalesce("noncurrent_bytes", F.lit(0)),
            "ops": ops_cost(access, prices),
            "read_gb": F.coalesce(access["egress_gb_30d"], F.lit(0.0)),
            "versioned": F.coalesce("versioning", F.lit(False)),
        }
    )
    min_days = fixed.STORAGE_MIN_DAYS
    targets = {f"target{i}": _target(F.col("heat"), i) for i in range(4)}
    df = df.withColumns(targets)
    # A band never moves to a class warmer than the default class of the bucket.
    df = df.withColumns(
        {
            f"class{i}": F.when(
                _by_class(F.col(f"target{i}"), min_days) < _by_class(current, min_days), current
            ).otherwise(F.col(f"target{i}"))
            for i in range(4)
        }
    )
    live = sum((F.col(f"bytes{i}") for i in range(1, 4)), F.col("bytes0"))
    df = df.withColumns(
        {
            "live": live,
            **{
                f"p_{c}": sum(
                    (F.when(F.col(f"class{i}") == c, F.col(f"bytes{i}")).otherwise(0) for i in range(1, 4)),
                    F.when(F.col("class0") == c, F.col("bytes0")).otherwise(0),
                )
                for c in CLASSES
            },
        }
    )
    divisor = F.greatest(F.col("live"), F.lit(1)).cast("double")
    cold_fraction = (F.col("p_NEARLINE") + F.col("p_COLDLINE") + F.col("p_ARCHIVE")) / divisor
    retrieval = sum(
        (F.col("read_gb") * cold_fraction * (F.col(f"p_{c}") / divisor) * retrieval_price(prices, c) for c in CLASSES[1:]),
        F.lit(0.0),
    )
    storage = sum((F.col(f"p_{c}") / GB * class_price(prices, c) for c in CLASSES), F.lit(0.0))
    current_price = _by_class(current, {c: class_price(prices, c) for c in CLASSES})
    noncurrent = F.col("noncurrent").cast("double")
    # Of noncurrent bytes about a fifth is younger than the retention and stays.
    kept_noncurrent = F.when(F.col("versioned") & (noncurrent > 0), noncurrent * 0.2).otherwise(noncurrent)
    df = df.withColumns(
        {
            "retrieval": retrieval,
            "current_cost": (F.col("live") + F.col("noncurrent")) / GB * current_price + F.col("ops"),
        }
    )
    proposed = storage + F.col("ops") + F.col("retrieval") + kept_noncurrent / GB * current_price
    df = df.withColumn("proposed_cost", F.greatest(F.lit(0.0), proposed))
    if guard:
        worse = (F.col("retrieval") > 0) & (F.col("proposed_cost") > F.col("current_cost"))
        df = df.withColumn("proposed_cost", F.when(worse, F.col("current_cost")).otherwise(F.col("proposed_cost")))
    df = df.withColumns(
        {
            "current_monthly": rounded(F.col("current_cost")),
            "proposed_monthly": rounded(F.col("proposed_cost")),
            "rules": _rules(noncurrent_days, keep_versions),
            "notes": _notes(noncurrent_days, keep_versions),
        }
    )
    return df.select(
        F.col("name").alias("bucket"),
        current.alias("current_class"),
        (F.col("live") + F.col("noncurrent")).alias("total_bytes"),
        "current_monthly",
        "proposed_monthly",
        rounded(F.col("current_monthly") - F.col("proposed_monthly")).alias("saving"),
        "rules",
        "notes",
    )


def _rules(noncurrent_days: int, keep_versions: int) -> Column:
    """Class transitions from warm to cold, then deletion of noncurrent versions."""
    current = F.col("storage_class")
    none_int, none_bool = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    none_list = F.lit(None).cast("array<string>")

    def rule(kind: str, cls=None, age=none_int, match=none_list, live=none_bool, since=none_int, newer=none_int) -> Column:
        return F.struct(
            F.struct(F.lit(kind).alias("type"), F.lit(cls).cast("string").alias("storageClass")).alias("action"),
            F.struct(
                age.alias("age"),
                match.alias("matchesStorageClass"),
                live.alias("isLive"),
                since.alias("daysSinceNoncurrentTime"),
                newer.alias("numNewerVersions"),
            ).alias("condition"),
        )

    rules = []
    for position, cls in enumerate(CLASSES[1:], start=1):
        used = F.lit(False)
        start = None
        for i, band in enumerate(BANDS):
            used = used | (F.col(f"class{i}") == cls)
            hit = F.col(f"target{i}") == cls
            first = fixed.AGE_BAND_START[band]
            start = F.when(hit, first) if start is None else start.when(hit, first)
        warmer = F.array(*[F.lit(c) for c in CLASSES[:position]])
        own = _by_class(current, {c: n for n, c in enumerate(CLASSES)})
        match = F.slice(warmer, own + 1, F.greatest(F.lit(position) - own, F.lit(0)))
        rules.append(F.when(used & (current != cls), rule("SetStorageClass", cls, age=start.cast("int"), match=match)))
    old = F.col("versioned") & (F.col("noncurrent") > 0)
    rules.append(F.when(old, rule("Delete", live=F.lit(False), since=F.lit(noncurrent_days))))
    rules.append(F.when(old, rule("Delete", live=F.lit(False), newer=F.lit(keep_versions))))
    return F.array_compact(F.array(*rules))


def _notes(noncurrent_days: int, keep_versions: int) -> Column:
    n_rules = F.size(F.coalesce(F.col("lifecycle_rules").cast("array<string>"), F.array().cast("array<string>")))
    missing = [F.coalesce(map_label(F.col("labels"), k), F.lit("")) == "" for k in ("env", "team")]
    return F.array_compact(
        F.array(
            F.when(n_rules > 0, fill(fixed.NOTE_RULES, n=n_rules)),
            F.when(
                F.col("versioned") & (F.col("noncurrent") > 0),
                fill(fixed.NOTE_VERSIONS, size=fmt_bytes(F.col("noncurrent")), days=noncurrent_days, keep=keep_versions),
            ),
            F.when(
                F.col("retrieval") > 0,
                fill(fixed.NOTE_RETRIEVAL, cost=fmt_money(F.col("retrieval")), gb=F.col("read_gb")),
            ),
            F.when(F.col("heat") == "hot", F.lit(fixed.NOTE_HOT)),
            F.when(missing[0] | missing[1], F.lit(fixed.NOTE_UNLABELLED)),
        )
    )


def rules_json(rules: Column) -> Column:
    """Lifecycle document as JSON text; unset conditions are left out."""
    return F.to_json(F.struct(F.struct(rules.alias("rule")).alias("lifecycle")))


def bucket_findings(plans: DataFrame) -> DataFrame:
    saving, rules = F.col("saving"), F.col("rules")
    return finding(
        plans,
        "gcs-lifecycle",
        F.col("bucket"),
        F.when(saving > 100, "high").when(saving > 10, "medium").otherwise("low"),
        saving,
        F.when(F.size(rules) > 0, fill(fixed.RULES_TEXT, n=F.size(rules))).otherwise(fixed.RULES_NONE),
        F.to_json(F.struct("rules", "notes")),
    )


def total_saving(plans: DataFrame) -> DataFrame:
    cents = F.sum(F.col("saving").cast("decimal(18,2)"))
    return plans.agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(cents, F.lit(0)).cast("double").alias("monthly_saving"))


def sort_plans(plans: DataFrame) -> DataFrame:
    return plans.orderBy(F.col("saving").desc(), "bucket")


def class_band_cost(buckets: DataFrame, prices: dict) -> DataFrame:
    """Storage cost by class and operations cost over all buckets, as they are now."""
    stored = F.aggregate(F.map_values("age_distribution_bytes"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = buckets.groupBy(F.col("storage_class").alias("class")).agg(
        F.sum((stored + F.coalesce("noncurrent_bytes", F.lit(0))).cast("decimal(38,0)")).cast("double").alias("bytes"),
        F.sum(F.coalesce("access_pattern.class_a_ops_30d", F.lit(0))).alias("class_a_ops"),
        F.sum(F.coalesce("access_pattern.class_b_ops_30d", F.lit(0))).alias("class_b_ops"),
    )
    ops = F.col("class_a_ops") / 10_000.0 * price(prices, "gcs", "class_a_ops_per_10k") + F.col(
        "class_b_ops"
    ) / 10_000.0 * price(prices, "gcs", "class_b_ops_per_10k")
    unit = _by_class(F.col("class"), {c: class_price(prices, c) for c in CLASSES})
    return sums.select(
        "class", "bytes", rounded(F.col("bytes") / GB * unit).alias("storage_monthly"), rounded(ops).alias("ops_monthly")
    )


def unit_prices(prices: DataFrame) -> DataFrame:
    """Storage, retrieval price and minimum days per class from a (section, key, price) book."""
    gcs = prices.filter(F.col("section") == "gcs")
    named = gcs.select(
        F.upper(F.substring_index("key", "_", 1)).alias("class"),
        F.when(F.col("key").endswith("_retrieval_gb"), "retrieval_per_gb").when(F.col("key").endswith("_gb_month"), "storage_gb_month").alias("kind"),
        "price",
    ).filter(F.col("class").isin(*CLASSES) & F.col("kind").isNotNull())
    return (
        named.groupBy("class")
        .pivot("kind", ["storage_gb_month", "retrieval_per_gb"])
        .agg(F.max("price"))
        .select(
            "class",
            "storage_gb_month",
            F.coalesce("retrieval_per_gb", F.lit(0.0)).alias("retrieval_per_gb"),
            _by_class(F.col("class"), fixed.STORAGE_MIN_DAYS).alias("min_days"),
        )
    )


def age_band(created: Column, as_of: dt.date) -> Column:
    days = calendar_days(created, day_lit(as_of))
    return F.when(days < 30, BANDS[0]).when(days < 90, BANDS[1]).when(days < 365, BANDS[2]).otherwise(BANDS[3])


def age_bands(objects: DataFrame, as_of: dt.date) -> DataFrame:
    """Bytes per bucket and age band of an object listing, one column per band."""
    return (
        objects.filter(F.col("created") <= day_lit(as_of))
        .groupBy("bucket")
        .agg(
            *[
                F.coalesce(F.sum(F.when(age_band(F.col("created"), as_of) == b, F.col("size_bytes"))), F.lit(0)).alias(
                    f"bytes_{b.replace('-', '_').replace('+', '_up')}"
                )
                for b in BANDS
            ]
        )
    )


def class_mix(objects: DataFrame, as_of: dt.date) -> DataFrame:
    """Bytes per storage class and month of creation, with the month before next to them."""
    monthly = (
        objects.filter(F.col("created") <= day_lit(as_of))
        .groupBy("storage_class", F.trunc("created", "MM").alias("month"))
        .agg(F.sum("size_bytes").alias("bytes"))
    )
    before = F.lag("bytes").over(Window.partitionBy("storage_class").orderBy("month"))
    return monthly.select(
        "storage_class", "month", "bytes", before.alias("bytes_before"), (F.col("bytes") - before).alias("change")
    )
