"""Sinks: findings, run-dated reports and the anomaly feed."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster shares through ``spark.checkpoint.dir``.

    A local temporary folder is used only where the setting is missing and Spark runs locally.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="outlay-")
    return f"{base.rstrip('/')}/outlay/{purpose}-{uuid.uuid4().hex}"


def overwrite_partitions(df: DataFrame, path: str, *partitions: str, fmt: str = "parquet") -> None:
    """Replace only the partitions that occur in ``df``, so that a repeated run changes nothing.

    The rebalance gathers each partition into few files and splits it where it is large.
    """
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).format(fmt).save(path)


def write_findings(findings: DataFrame, path: str, run_date: dt.date, fmt: str = "json") -> None:
    """Findings with their fields in name order, one partition per run."""
    ordered = findings.select(*sorted(findings.columns), F.lit(run_date).alias("run_date"))
    overwrite_partitions(ordered, path, "run_date", fmt=fmt)


def write_report(report: DataFrame, base: str, name: str, run_date: dt.date, fmt: str = "parquet") -> str:
    """A report table below its run date; returns the path of the table."""
    path = f"{base}/{name}"
    overwrite_partitions(report.withColumn("run_date", F.lit(run_date)), path, "run_date", fmt=fmt)
    return path


def append_anomalies(anomalies: DataFrame, path: str) -> None:
    """One day's anomalies into the feed; running a day again replaces that day."""
    overwrite_partitions(anomalies, path, "usage_date")
