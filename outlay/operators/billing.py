"""Billing analytics: service, showback, namespace, commitment, credit, disk and egress cost."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import calendar_days, day_lit, local_time, ts_lit, utc_time
from outlay.functions.labels import has_label, label_value
from outlay.functions.money import MONEY, credits_of_type, dmoney, fold_credits, net_cost, ratio, rounded
from outlay.functions.text import egress_class, first_token, lookup_text
from outlay.operators.shares import share_of, share_within, with_grand_total
from outlay.sources.billing import asset_scan, billing_scan, billing_scan_months, usage_day


def service_name() -> Column:
    return F.col("service.description")


def sku_text() -> Column:
    return F.col("sku.description")


def line_net() -> Column:
    return net_cost(F.col("cost"), F.col("credits"))


def project_or_account() -> Column:
    return F.coalesce(F.col("project.id"), F.lit(fixed.NO_PROJECT))


def _dsum(cond: Column, value: Column) -> Column:
    """Conditional sum of a decimal."""
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast(MONEY)))


def cost_by_service(lines: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Current against previous window per service, with the share of the current total."""
    base = billing_scan(lines, as_of, 2 * window_days)
    border = day_lit(as_of - dt.timedelta(days=window_days))
    grouped = (
        base.select(service_name().alias("service"), usage_day().alias("day"), line_net().alias("net"))
        .groupBy("service")
        .agg(
            _dsum(F.col("day") >= border, F.col("net")).alias("cur"),
            _dsum(F.col("day") < border, F.col("net")).alias("prev"),
        )
        .filter((F.col("cur") > 0) | (F.col("prev") > 0))
    )
    return with_grand_total(grouped, ["cur", "prev"]).select(
        "service",
        dmoney(F.col("cur")).alias("current_30d"),
        dmoney(F.col("prev")).alias("previous_30d"),
        dmoney(F.col("cur") - F.col("prev")).alias("delta"),
        rounded(ratio(F.col("cur") - F.col("prev"), F.col("prev")) * 100, 1).alias("delta_pct"),
        share_of(F.col("cur"), F.col("total_cur"), 1).alias("share_pct"),
    )


def label_chain(key: str, resource_fallback: bool = True) -> Column:
    """Project label, then resource label, then the literal for unlabelled spend."""
    chain = [label_value(F.col("project.labels"), key)]
    if resource_fallback:
        chain.append(label_value(F.col("labels"), key))
    return F.coalesce(*chain, F.lit(fixed.UNLABELLED))


def showback_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("invoice.month").alias("invoice_month"),
        label_chain("env").alias("env"),
        label_chain("team").alias("team"),
        # The cost centre is read from the project only.
        label_chain("cost-center", resource_fallback=False).alias("cost_center"),
        project_or_account().alias("project_id"),
        line_net().alias("net"),
    )


def cost_by_label(lines: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Monthly showback; groups whose rounded cost is 0 leave before the shares are taken."""
    keys = ["invoice_month", "env", "team", "cost_center", "project_id"]
    grouped = (
        showback_lines(billing_scan_months(lines, as_of, months))
        .groupBy(*keys)
        .agg(F.sum("net").alias("net"))
        .filter(F.round("net", 2) != 0)
    )
    return share_within(grouped, "net", ["invoice_month"], "share_of_month_pct", 2).select(
        *keys, dmoney(F.col("net")).alias("net_cost"), "share_of_month_pct"
    )


def cluster_lines(lines: DataFrame) -> DataFrame:
    """Lines that carry a cluster label, with namespace, pricing model and net cost."""
    return lines.filter(
        service_name().isin(fixed.COMPUTE_SERVICE, fixed.KUBERNETES_SERVICE) & has_label(F.col("labels"), fixed.CLUSTER_LABEL)
    ).select(
        F.col("project.id").alias("project_id"),
        label_value(F.col("labels"), fixed.CLUSTER_LABEL).alias("cluster"),
        F.coalesce(label_value(F.col("labels"), fixed.NAMESPACE_LABEL), F.lit(fixed.UNALLOCATED)).alias("namespace"),
        F.when(sku_text().rlike(fixed.RE_SPOT), "spot").otherwise("on-demand").alias("pricing_model"),
        line_net().alias("net"),
    )


def cost_by_namespace(lines: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Cluster cost per namespace and pricing model for lines that carry a cluster label."""
    keys = ["project_id", "cluster", "namespace", "pricing_model"]
    grouped = cluster_lines(billing_scan(lines, as_of, window_days)).groupBy(*keys).agg(F.sum("net").alias("net"))
    return share_within(grouped, "net", ["project_id", "cluster"], "share_of_cluster_pct", 1).select(
        *keys,
        dmoney(F.col("net")).alias("net_cost_30d"),
        rounded(F.col("net").cast("double") / window_days, 2).alias("avg_daily_cost"),
        "share_of_cluster_pct",
    )


def commitment_lines(lines: DataFrame) -> DataFrame:
    """Compute lines marked as eligible usage or commitment fee, with their typed credits."""
    spec = label_value(F.col("system_labels"), fixed.MACHINE_SPEC_LABEL)
    flat = lines.filter(service_name() == fixed.COMPUTE_SERVICE).select(
        F.col("invoice.month").alias("invoice_month"),
        F.col("usage_start_time"),
        F.col("location.region").alias("region"),
        first_token(spec).alias("machine_family"),
        sku_text().alias("sku"),
        "cost",
        F.col("usage.amount_in_pricing_units").alias("usage_amount"),
        "credits",
    )
    sku, credits = F.col("sku"), F.col("credits")
    return flat.select(
        *[c for c in flat.columns if c not in ("sku", "credits")],
        credits_of_type(credits, *fixed.CUD_CREDIT_TYPES).alias("cud"),
        credits_of_type(credits, fixed.SUD_CREDIT_TYPE).alias("sud"),
        sku.rlike(fixed.RE_COMMITMENT_FEE).alias("is_fee"),
        (sku.rlike(fixed.RE_ELIGIBLE) & ~sku.rlike(fixed.RE_NOT_ELIGIBLE)).alias("is_eligible"),
    )


def commitment_sums(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Exact decimal sums per group; groups without eligible cost or fee are dropped."""
    eligible, fee = F.col("is_eligible"), F.col("is_fee")
    return (
        marked.groupBy(*keys)
        .agg(
            _dsum(eligible, F.col("cost")).alias("eligible"),
            (-_dsum(eligible, F.col("cud"))).alias("cud"),
            (-_dsum(eligible, F.col("sud"))).alias("sud"),
            _dsum(fee, F.col("cost")).alias("fee"),
        )
        .filter((F.round("eligible", 2) > 0) | (F.round("fee", 2) > 0))
    )


def commitment_columns() -> list[Column]:
    zero = F.lit(0).cast(MONEY)
    return [
        dmoney(F.col("eligible")).alias("eligible_on_demand_cost"),
        dmoney(F.col("cud")).alias("cud_credit_applied"),
        dmoney(F.col("sud")).alias("sud_credit_applied"),
        dmoney(F.col("fee")).alias("commitment_fees"),
        rounded(ratio(F.col("cud"), F.col("eligible")) * 100, 1).alias("cud_coverage_pct"),
        dmoney(F.greatest(F.col("fee") - F.col("cud"), zero)).alias("idle_cud_cost"),
    ]


def commitment_coverage(
    lines: DataFrame, as_of: dt.date, window_days: int = 30, by: tuple[str, ...] = ("region", "machine_family")
) -> DataFrame:
    """Coverage and idle commitment; fees without a machine spec fall to the family ``unknown``.

    ``by=("region",)`` sets fees and usage of a region against each other.
    """
    marked = commitment_lines(billing_scan(lines, as_of, window_days))
    return commitment_sums(marked, list(by)).select(*by, *commitment_columns())


def credits_breakdown(lines: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Value of each credit type per month and service against the month's list cost.

    Each line is exploded into its list cost (NULL type) and its credits, so one aggregation
    gives both the credit sums and, summed over the month, the list cost without fan-out.
    """
    entry = f"struct<type:string,amount:{MONEY},listed:{MONEY}>"
    zero = F.lit(0).cast(MONEY)
    listed = F.array(F.struct(F.lit(None).cast("string").alias("type"), zero.alias("amount"), F.col("cost").alias("listed")))
    credited = F.zip_with(
        F.col("credits")["type"],
        F.col("credits")["amount"],
        lambda kind, x: F.struct(kind.alias("type"), F.coalesce(x, zero).alias("amount"), zero.alias("listed")),
    )
    grouped = (
        billing_scan_months(lines, as_of, months)
        .select(
            F.col("invoice.month").alias("invoice_month"),
            service_name().alias("service"),
            F.explode(F.concat(listed.cast(f"array<{entry}>"), F.coalesce(credited.cast(f"array<{entry}>"), F.array().cast(f"array<{entry}>")))).alias("e"),
        )
        .groupBy("invoice_month", "service", F.col("e.type").alias("credit_type"))
        .agg(F.sum("e.amount").alias("credited"), F.sum("e.listed").alias("listed"))
    )
    # A month has as many rows here as services times credit types, so its window is small.
    month_list = F.sum("listed").over(Window.partitionBy("invoice_month"))
    return (
        grouped.withColumn("month_list", month_list)
        .filter(F.col("credit_type").isNotNull() & F.col("invoice_month").isNotNull())
        .select(
            "invoice_month",
            "service",
            "credit_type",
            dmoney(-F.col("credited")).alias("credit_value"),
            rounded(ratio(-F.col("credited"), F.col("month_list")) * 100, 2).alias("pct_of_month_list_cost"),
            lookup_text(F.col("credit_type"), fixed.CREDIT_MEANINGS, fixed.CREDIT_MEANING_OTHER).alias("meaning"),
        )
    )


def disk_versions(assets: DataFrame) -> DataFrame:
    """Every version of a disk by the fields that count; its document goes no further than the scan.

    ``version`` orders the versions of a disk: by update time (none comes first), and equal ones by a hash of the
    document. One decimal holds both, so aggregates over it keep buffers of fixed width and hash.
    """
    doc = F.col("data")
    micros = F.timestamp_diff("MICROSECOND", ts_lit(dt.datetime(1970, 1, 1)), F.col("update_time").cast("timestamp_ntz"))
    whole = lambda x: x.cast("decimal(19,0)")
    version = whole(F.coalesce(micros, F.lit(-(1 << 62)))) * F.lit(Decimal(1 << 64)) + whole(F.xxhash64(doc))
    return asset_scan(assets).select(
        F.col("name").alias("asset_name"),
        "update_time",
        version.cast("decimal(38,0)").alias("version"),
        F.coalesce(F.json_array_length(F.get_json_object(doc, "$.users")), F.lit(0)).alias("attached_count"),
        F.get_json_object(doc, "$.labels.keep").alias("keep_label"),
        utc_time(F.get_json_object(doc, "$.lastDetachTimestamp")).alias("last_detach"),
    )


def disk_states(assets: DataFrame) -> DataFrame:
    """``asset_name, attached_count, keep_label, last_detach`` of the newest version of every asset.

    The newest version for each value of the label comes first: that combines on the map side, so an asset
    with very many versions sends a row for each task and label value. The label is the only text, and as a key it needs no
    buffer. The window then holds the label values of one asset.
    """
    newest = Window.partitionBy("asset_name").orderBy(F.col("version").desc())
    return (
        disk_versions(assets)
        .groupBy("asset_name", "keep_label")
        .agg(*[F.max_by(c, "version").alias(c) for c in ("attached_count", "last_detach")], F.max("version").alias("version"))
        .withColumn("place", F.row_number().over(newest))
        .filter("place = 1")
        .select("asset_name", "attached_count", "keep_label", "last_detach")
    )


def disk_cost_lines(lines: DataFrame, as_of: dt.date, window_days: int) -> DataFrame:
    """The window's lines of disks by name: what a disk is called, where it is, and the net cost."""
    resource = F.col("resource.global_name")
    return (
        billing_scan(lines, as_of, window_days)
        .filter((service_name() == fixed.COMPUTE_SERVICE) & sku_text().rlike(fixed.RE_DISK_SKU) & resource.like(fixed.DISK_NAME_LIKE))
        .select(
            "usage_start_time",
            resource.alias("disk_global_name"),
            F.col("resource.name").alias("disk_name"),
            F.col("project.id").alias("project_id"),
            F.col("location.zone").alias("zone"),
            sku_text().alias("sku"),
            line_net().alias("net"),
        )
    )


def unattached_disk_cost(lines: DataFrame, assets: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Cost of disks whose latest asset version lists no user."""
    keys = ["disk_global_name", "disk_name", "project_id", "zone", "sku"]
    cost = disk_cost_lines(lines, as_of, window_days).groupBy(*keys).agg(F.sum("net").alias("net"))
    # Only names of this form can join, so other assets leave before their versions are compared.
    disks = assets.filter(F.col("name").like(fixed.DISK_NAME_LIKE))
    idle = disk_states(disks).filter(F.col("attached_count") == 0)
    return cost.join(idle, cost.disk_global_name == idle.asset_name, "inner").select(
        "project_id",
        "zone",
        "disk_name",
        "sku",
        dmoney(F.col("net")).alias("net_cost_30d"),
        "last_detach",
        calendar_days(F.col("last_detach"), day_lit(as_of)).alias("days_unattached"),
        (F.col("keep_label") == "true").alias("excluded_by_label"),
    )


def egress_cost(lines: DataFrame, as_of: dt.date, window_days: int = 30) -> DataFrame:
    """Egress volume and cost per destination class; groups of at most 1.00 are dropped first."""
    keys = ["project_id", "egress_class", "service"]
    grouped = (
        billing_scan(lines, as_of, window_days)
        .filter(sku_text().rlike(fixed.RE_EGRESS) & F.col("usage.pricing_unit").isin(*fixed.EGRESS_UNITS))
        # Plain columns first: the class reads the text several times.
        .select(
            F.col("project.id").alias("project_id"),
            sku_text().alias("sku"),
            service_name().alias("service"),
            F.col("usage.amount_in_pricing_units").alias("gib"),
            line_net().alias("net"),
        )
        .withColumn("egress_class", egress_class(F.col("sku")))
        .groupBy(*keys)
        .agg(F.sum("gib").alias("gib"), F.sum("net").alias("net"))
        .filter(F.round("net", 2) > 1)
    )
    return with_grand_total(grouped, ["gib", "net"]).select(
        *keys,
        rounded(F.col("gib"), 1).alias("gib_30d"),
        dmoney(F.col("net")).alias("net_cost_30d"),
        rounded(ratio(F.col("net"), F.col("gib")), 4).alias("effective_price_per_gib"),
        share_of(F.col("net"), F.col("total_net"), 1).alias("share_pct"),
    )


# ------------------------------------------------------------------ views
def v_cost_daily(lines: DataFrame, tz: str = "Asia/Kolkata") -> DataFrame:
    """Dashboard view: local usage date and flattened labels; tax lines stay in."""
    return lines.select(
        F.to_date(local_time(F.col("usage_start_time"), tz)).alias("usage_date"),
        F.col("project.id").alias("project_id"),
        service_name().alias("service"),
        sku_text().alias("sku"),
        F.col("location.region").alias("region"),
        label_value(F.col("project.labels"), "env").alias("env"),
        label_value(F.col("project.labels"), "team").alias("team"),
        label_value(F.col("project.labels"), "cost-center").alias("cost_center"),
        label_value(F.col("labels"), "app").alias("app"),
        label_value(F.col("labels"), fixed.NAMESPACE_LABEL).alias("k8s_namespace"),
        "cost",
        fold_credits_or_null(F.col("credits")).alias("credits"),
        "currency",
    )


def register_cost_view(lines: DataFrame, name: str = "v_cost_daily", tz: str = "Asia/Kolkata") -> DataFrame:
    """The dashboard view under a name for SQL."""
    view = v_cost_daily(lines, tz)
    view.createOrReplaceTempView(name)
    return view


def fold_credits_or_null(credits: Column) -> Column:
    """Credit sum as the view shows it: NULL when the line has no credit."""
    return F.when(F.size(credits["amount"]) > 0, fold_credits(credits))


def export_health(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.min("usage_start_time").alias("first_row"),
        F.max("export_time").alias("latest_export"),
        F.count(F.lit(1)).alias("rows_total"),
    )


def cost_between(lines: DataFrame, start_yyyymmdd: str, end_yyyymmdd: str, tz: str = "Asia/Kolkata") -> DataFrame:
    """Rows of the dashboard view between two local days given as text, both included.

    The local days decide. What they imply for the stored times, within a day for any time zone, bounds
    the scan: lines arrive on their day at the earliest.
    """
    start, end = (dt.datetime.strptime(x, "%Y%m%d").date() for x in (start_yyyymmdd, end_yyyymmdd))
    day = dt.timedelta(days=1)
    near = lines.filter(
        (F.col("usage_start_time") >= F.lit(dt.datetime.combine(start - day, dt.time())).cast(lines.schema["usage_start_time"].dataType))
        & (F.col("usage_start_time") < F.lit(dt.datetime.combine(end + 2 * day, dt.time())).cast(lines.schema["usage_start_time"].dataType))
        & (F.col("ingest_date") >= F.lit(start - day))
    )
    return v_cost_daily(near, tz).filter(F.col("usage_date").between(F.lit(start), F.lit(end)))
