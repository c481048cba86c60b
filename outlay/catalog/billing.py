"""Billing queries over the stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from outlay.binding import tables as b
from outlay.functions.money import dmoney
from outlay.operators import anomalies, billing, disk_history
from outlay.sources import billing as scans

AS_OF = b.AS_OF
SINCE = dt.date(2000, 3, 1)
QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _scan_summary(df):
    return df.groupBy(billing.service_name().alias("service")).agg(
        F.count(F.lit(1)).alias("lines"),
        dmoney(F.sum("cost")).alias("cost"),
        F.min(scans.usage_day()).alias("first_day"),
        F.max(scans.usage_day()).alias("last_day"),
    )


@query("SRC1_billing_scan")
def _(spark, sf):
    return _scan_summary(scans.billing_scan(b.billing(spark, sf), AS_OF, 30))


@query("SRC2_billing_scan_months")
def _(spark, sf):
    return _scan_summary(scans.billing_scan_months(b.billing(spark, sf), AS_OF, 3))


@query("SRC3_asset_scan")
def _(spark, sf):
    return (
        scans.asset_scan(b.disk_assets(spark, sf))
        .groupBy("name")
        .agg(F.count("data").alias("versions"), F.max("update_time").alias("newest"))
    )


def _view(spark, sf):
    return _doubles(billing.v_cost_daily(b.billing(spark, sf, hourly=True)))


def _doubles(view):
    return view.withColumn("cost", F.col("cost").cast("double")).withColumn("credits", F.col("credits").cast("double"))


@query("V1_cost_daily_view")
def _(spark, sf):
    return _view(spark, sf)


@query("V2_export_health")
def _(spark, sf):
    return billing.export_health(b.billing(spark, sf))


@query("V3_cost_between")
def _(spark, sf):
    return _doubles(billing.cost_between(b.billing(spark, sf, hourly=True), "20000501", "20000531"))


@query("B1_cost_by_service")
def _(spark, sf):
    return billing.cost_by_service(b.billing(spark, sf), AS_OF)


@query("B2_cost_by_label")
def _(spark, sf):
    return billing.cost_by_label(b.billing(spark, sf), AS_OF)


@query("B3_cost_by_namespace")
def _(spark, sf):
    return billing.cost_by_namespace(b.billing(spark, sf), AS_OF)


@query("B4_commitment_coverage")
def _(spark, sf):
    return billing.commitment_coverage(b.billing(spark, sf), AS_OF)


@query("B5_credits_breakdown")
def _(spark, sf):
    return billing.credits_breakdown(b.billing(spark, sf), AS_OF)


@query("B6_unattached_disk_cost")
def _(spark, sf):
    return billing.unattached_disk_cost(b.billing(spark, sf), b.disk_assets(spark, sf), AS_OF)


@query("B6_idle_disk_days")
def _(spark, sf):
    return disk_history.idle_disk_cost(b.billing(spark, sf), b.disk_assets(spark, sf), AS_OF)


@query("B7_egress_cost")
def _(spark, sf):
    return billing.egress_cost(b.billing(spark, sf), AS_OF)


@query("B8_daily_anomalies")
def _(spark, sf):
    return anomalies.daily_anomalies(b.billing(spark, sf), AS_OF)


@query("B8a_densify_daily")
def _(spark, sf):
    daily = anomalies.daily_cost(scans.billing_scan(b.billing(spark, sf), AS_OF, 30))
    first = AS_OF - dt.timedelta(days=30)
    dense = anomalies.densify_daily(daily, anomalies.KEYS, F.lit(first), F.lit(AS_OF))
    return dense.withColumn("net_cost", dmoney(F.col("net_cost"), 4))


@query("B8b_backfill_anomalies")
def _(spark, sf):
    return anomalies.daily_anomalies(b.billing(spark, sf), AS_OF, score_since=SINCE)
