"""Documents: inventories, price books, autoscaler lists and schedule files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay import fixed, schemas

# A document that is not what its schema says stops the job; it must not look like an empty one.
STRICT = {"mode": "FAILFAST"}


def parse_inventory(docs: DataFrame) -> dict[str, DataFrame]:
    """The named lists of inventory documents (column ``value``, one JSON object per row).

    Each list becomes a relation of its own; a missing list gives no rows, a broken document an error.
    """
    out = {}
    for name, list_type in schemas.INVENTORY.items():
        parsed = docs.select(F.from_json("value", f"{name} {list_type}", STRICT).alias("doc"))
        out[name] = parsed.select(F.inline(F.col(f"doc.{name}")))
    return out


def load_inventory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Inventory document files: whole-file JSON, any number of files under ``path``."""
    return parse_inventory(spark.read.text(path, wholetext=True))


def load_prices(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Price book as (section, key, price)."""
    book = load_price_book(spark, path)
    rows = [(s, k, float(v)) for s, section in book.items() for k, v in section.items()]
    return spark.createDataFrame(rows, "section string, key string, price double")


def load_price_book(spark: SparkSession, path: str | None = None) -> dict:
    """Price book as nested dictionaries for use in literals; the defaults when no path is given.

    A price book is a configuration file of a few dozen numbers.
    """
    if path is None:
        return fixed.DEFAULT_PRICES
    files = spark.read.text(path, wholetext=True).take(2)
    if len(files) != 1:
        raise ValueError(f"{path}: a price book is one file")
    return {k: v for k, v in json.loads(files[0]["value"]).items() if isinstance(v, dict)}


def flatten_vpa(docs: DataFrame) -> DataFrame:
    """Autoscaler list documents to one row per container target.

    Quantities carry the suffix m (CPU) or Mi (memory); any other form gives NULL.
    """
    items = docs.select(F.explode(F.from_json("value", schemas.VPA_ITEMS, STRICT)["items"]).alias("item"))
    recs = items.select(
        F.col("item.metadata.namespace").alias("namespace"),
        F.col("item.spec.targetRef.name").alias("workload"),
        F.explode("item.status.recommendation.containerRecommendations").alias("rec"),
    )
    return recs.select(
        "namespace",
        "workload",
        F.col("rec.containerName").alias("container"),
        F.regexp_replace("rec.target.cpu", "m$", "").try_cast("int").alias("target_cpu_m"),
        F.regexp_replace("rec.target.memory", "Mi$", "").try_cast("int").alias("target_mem_mi"),
    )


def parse_pools(lines: DataFrame) -> DataFrame:
    """Schedule config lines: whitespace separated, # comments and blank lines skipped."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = F.split("text", " ")
    return (
        lines.select(text.alias("text"))
        .filter((F.col("text") != "") & ~F.col("text").startswith("#"))
        .select(
            parts[0].alias("project"),
            F.get(parts, F.lit(1)).alias("cluster"),
            F.get(parts, F.lit(2)).alias("location"),
            F.get(parts, F.lit(3)).alias("pool"),
            F.get(parts, F.lit(4)).try_cast("int").alias("day_count"),
        )
    )


def load_pools(spark: SparkSession, path: str) -> DataFrame:
    return parse_pools(spark.read.text(path))
