"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators between words and the letters that are lower-cased.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder serves a local session; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="outlay-llm-")
    return f"{base.rstrip('/')}/outlay-llm/{purpose}-{uuid.uuid4().hex}"


def posix_path(folder: str) -> str:
    """The path of a shared folder that processes open directly (memory-mapped files need one)."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{folder}: memory-mapped files need a folder mounted on every node")
    return parts.path


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """Words between white space, in order; NULL for a NULL text."""
    return F.array_remove(F.split(text, SPACES), "")


def sum_by_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums by key; they combine on the map side, so a hot key costs a row for each task."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))
