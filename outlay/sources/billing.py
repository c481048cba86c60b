"""Billing export scans.

The bounds are literals, so on a table partitioned by ``ingest_date`` they become partition
filters, and the usage-date bounds become Parquet filters on ``usage_start_time``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.functions.dates import day_lit, months_back

SLACK_DAYS = 3


def regular_only(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("cost_type") == "regular")


def usage_day() -> F.Column:
    return F.to_date("usage_start_time")


def billing_scan(lines: DataFrame, as_of: dt.date, window_days: int, slack: int = SLACK_DAYS) -> DataFrame:
    """Regular lines used in the last ``window_days`` days, both ends included.

    Lines arrive late, so the ingestion bound reaches ``slack`` days further back.
    """
    first_use = as_of - dt.timedelta(days=window_days)
    return regular_only(lines).filter(
        (F.col("ingest_date") >= day_lit(first_use - dt.timedelta(days=slack)))
        & (F.col("ingest_date") <= day_lit(as_of))
        & (usage_day() >= day_lit(first_use))
        & (usage_day() <= day_lit(as_of))
    )


def billing_scan_months(lines: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Regular lines ingested since the first day of the month ``months`` months back."""
    return regular_only(lines).filter(
        (F.col("ingest_date") >= day_lit(months_back(as_of, months)))
        & (F.col("ingest_date") <= day_lit(as_of))
        & (usage_day() <= day_lit(as_of))
    )


def asset_scan(assets: DataFrame) -> DataFrame:
    """Asset versions with the document text at top level."""
    return assets.select("name", "update_time", F.col("resource.data").alias("data"))
