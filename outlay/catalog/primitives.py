"""The relational and scalar primitives of the billing analytics, each over the whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from outlay import fixed
from outlay.binding import tables as b
from outlay.functions.dates import calendar_days, day_lit, months_back
from outlay.functions.labels import has_label, label_value
from outlay.functions.money import MONEY, credits_of_type, dmoney, ratio, rounded
from outlay.functions.text import egress_class, first_token, lookup_text
from outlay.operators import anomalies, billing
from outlay.operators.shares import share_of, share_within, with_grand_total

AS_OF = b.AS_OF
QUERIES = {}


def service():
    return billing.service_name().alias("service")


def project():
    return billing.project_or_account().alias("project_id")


def count():
    return F.count(F.lit(1))


def query(name):
    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(b.billing(spark, sf))
        return fn

    return register


@query("P1_net_cost")
def _(lines):
    flat = lines.select(service(), billing.line_net().alias("net"), "cost")
    return flat.groupBy("service").agg(dmoney(F.sum("cost")).alias("cost"), dmoney(F.sum("net")).alias("net_cost"))


@query("P2_typed_credits")
def _(lines):
    c = F.col("credits")
    flat = lines.select(
        service(), credits_of_type(c, *fixed.CUD_CREDIT_TYPES).alias("cud"), credits_of_type(c, fixed.SUD_CREDIT_TYPE).alias("sud")
    )
    return flat.groupBy("service").agg(dmoney(F.sum("cud")).alias("cud"), dmoney(F.sum("sud")).alias("sud"))


@query("P3_label_lookup")
def _(lines):
    """Of two labels with one key the first counts."""
    team, spec = label_value(F.col("labels"), "team"), label_value(F.col("system_labels"), fixed.MACHINE_SPEC_LABEL)
    return lines.groupBy(team.alias("team"), spec.alias("machine_spec")).agg(count().alias("lines"))


@query("P4_label_fallback")
def _(lines):
    return lines.groupBy(
        billing.label_chain("env").alias("env"), billing.label_chain("cost-center", resource_fallback=False).alias("cost_center")
    ).agg(count().alias("lines"))


@query("P5_label_exists")
def _(lines):
    return lines.filter(has_label(F.col("labels"), fixed.CLUSTER_LABEL)).groupBy(service()).agg(count().alias("lines"))


@query("P6_unnest_keep_empty")
def _(lines):
    rows = lines.select(F.explode_outer("credits").alias("c"))
    return rows.groupBy(F.col("c.type").alias("credit_type")).agg(count().alias("rows_total"), dmoney(F.sum("c.amount")).alias("amount"))


@query("P7_regex_classes")
def _(lines):
    flat = lines.select(billing.sku_text().alias("sku")).filter(F.col("sku").rlike(fixed.RE_EGRESS))
    return flat.groupBy(egress_class(F.col("sku")).alias("egress_class")).agg(count().alias("lines"))


@query("P8_like_filter")
def _(lines):
    return lines.filter(F.col("resource.global_name").like(fixed.DISK_NAME_LIKE)).groupBy(service()).agg(count().alias("lines"))


@query("P9_predicates")
def _(lines):
    hit = (
        (billing.service_name().isin(fixed.COMPUTE_SERVICE, fixed.KUBERNETES_SERVICE) & F.to_date("usage_start_time").between(dt.date(1999, 1, 1), dt.date(1999, 12, 31)))
        | F.col("project.id").isNull()
    ) & ~(F.col("cost_type") == "tax")
    return lines.filter(hit).groupBy(service(), project()).agg(count().alias("lines"))


@query("P10_conditional_sum")
def _(lines):
    zero = F.lit(0).cast(MONEY)
    pick = lambda cond: dmoney(F.sum(F.when(cond, F.col("cost")).otherwise(zero)))
    tax = F.col("cost_type") == "tax"
    return lines.groupBy(project()).agg(pick(tax).alias("tax"), pick(~tax).alias("regular"))


@query("P11_safe_arithmetic")
def _(lines):
    sums = lines.groupBy(F.to_date("usage_start_time").alias("day")).agg(
        F.sum("cost").alias("cost"), F.sum(F.when(F.col("cost_type") == "tax", F.col("cost"))).alias("tax")
    )
    tax0 = F.coalesce("tax", F.lit(0).cast(MONEY))
    return sums.select(
        "day",
        rounded(ratio(F.col("cost"), F.nullif(tax0, F.lit(0).cast(MONEY)))).alias("cost_per_tax"),
        dmoney(F.abs(F.greatest(tax0, F.col("cost") / 10) - F.col("cost")), 1).alias("distance"),
    )


def _by_month_service(lines):
    month = F.col("invoice.month").alias("invoice_month")
    return lines.select(month, service(), billing.line_net().alias("net")).groupBy("invoice_month", "service").agg(F.sum("net").alias("net"))


@query("P12_window_over_aggregate")
def _(lines):
    shares = share_within(_by_month_service(lines), "net", ["invoice_month"], "share_pct", 2)
    return shares.withColumn("net", dmoney(F.col("net")))


@query("P13_grand_total_share")
def _(lines):
    grouped = _by_month_service(lines)
    return with_grand_total(grouped, ["net"]).select("invoice_month", "service", share_of(F.col("net"), F.col("total_net"), 4).alias("share_pct"))


@query("P14_having_rounded")
def _(lines):
    grouped = _by_month_service(lines).withColumn("net", F.round("net", -5))
    return grouped.filter(F.col("net") >= 200000).withColumn("net", F.col("net").cast("double"))


def _latest(spark, sf):
    return billing.disk_states(b.disk_assets(spark, sf))


QUERIES["P15_latest_version"] = lambda spark, sf: _latest(spark, sf).select("asset_name", "keep_label", "last_detach")
QUERIES["P23_json_fields"] = lambda spark, sf: (
    b.disk_assets(spark, sf)
    .select(
        F.json_array_length(F.get_json_object("resource.data", "$.users")).alias("users"),
        F.get_json_object("resource.data", "$.labels.keep").alias("keep"),
    )
    .groupBy("users", "keep")
    .agg(count().alias("versions"))
)


@query("P16_range_frame")
def _(lines):
    daily = anomalies.daily_cost(lines)
    week = Window.partitionBy(*anomalies.KEYS).orderBy(F.unix_date("usage_date")).rangeBetween(-7, -1)
    x = F.col("net_cost").cast("double")
    return daily.select(
        "usage_date",
        *anomalies.KEYS,
        rounded(F.avg(x).over(week)).alias("mean"),
        rounded(F.stddev_samp(x).over(week)).alias("deviation"),
        F.count("net_cost").over(week).alias("n"),
    )


@query("P17_calendar")
def _(lines):
    """Every day between the first and last use of each service, with the lines of the day."""
    daily = lines.groupBy(F.to_date("usage_start_time").alias("usage_date"), service()).agg(count().alias("n"))
    spans = daily.groupBy("service").agg(F.explode(F.sequence(F.min("usage_date"), F.max("usage_date"))).alias("usage_date"))
    return spans.join(daily, ["service", "usage_date"], "left").select("service", "usage_date", F.coalesce("n", F.lit(0)).alias("lines"))


@query("P18_distinct_keys")
def _(lines):
    """Distinct keys beside a calendar of three days, expanded per key."""
    keys = lines.select(project(), service()).distinct()
    days = F.explode(F.sequence(day_lit(AS_OF - dt.timedelta(days=2)), day_lit(AS_OF)))
    return keys.select("project_id", "service", days.alias("usage_date"))


@query("P19_left_join")
def _(lines):
    """Daily cost beside the cost of the same key one week before."""
    daily = anomalies.daily_cost(lines)
    before = daily.select(F.date_add("usage_date", 7).alias("usage_date"), *anomalies.KEYS, F.col("net_cost").alias("week_before"))
    return daily.join(before, ["usage_date", *anomalies.KEYS], "left").select(
        "usage_date", *anomalies.KEYS, dmoney(F.col("net_cost")).alias("net_cost"), dmoney(F.col("week_before")).alias("week_before")
    )


@query("P20_inner_join")
def _(lines):
    """Cost per project and month beside the month's list cost."""
    month = F.col("invoice.month").alias("invoice_month")
    per_project = lines.groupBy(month, project()).agg(F.sum("cost").alias("cost"))
    totals = lines.groupBy(month).agg(F.sum("cost").alias("listed"))
    return per_project.join(totals, "invoice_month", "inner").select(
        "invoice_month", "project_id", rounded(ratio(F.col("cost"), F.col("listed")) * 100).alias("pct")
    )


@query("P21_date_functions")
def _(lines):
    t = F.col("usage_start_time")
    return lines.groupBy(F.trunc(F.to_date(t), "MM").alias("month"), calendar_days(t, F.col("export_time")).alias("lag_days")).agg(
        F.min(F.unix_date(F.to_date(t))).alias("first_day_number"),
        F.max(F.date_sub(F.to_date(t), 30)).alias("window_start"),
        F.max(F.to_date(F.lit(months_back(AS_OF, 3).strftime("%Y%m%d")), "yyyyMMdd")).alias("months_start"),
        count().alias("lines"),
    )


@query("P22_split_first_token")
def _(lines):
    family = first_token(label_value(F.col("system_labels"), fixed.MACHINE_SPEC_LABEL))
    return lines.groupBy(family.alias("machine_family")).agg(count().alias("lines"))


@query("P24_code_texts")
def _(lines):
    # A plain explode puts a filter on the array below it, which builds the credits a second time.
    rows = lines.select(F.posexplode_outer("credits.type").alias("pos", "credit_type")).filter(F.col("pos").isNotNull())
    meaning = lookup_text(F.col("credit_type"), fixed.CREDIT_MEANINGS, fixed.CREDIT_MEANING_OTHER)
    return rows.groupBy("credit_type").agg(count().alias("credits")).withColumn("meaning", meaning)


@query("P25_order_by")
def _(lines):
    grouped = _by_month_service(lines).select("invoice_month", "service", dmoney(F.col("net")).alias("net_cost"))
    return grouped.orderBy(F.col("invoice_month").desc(), F.col("net_cost").desc())


@query("P26_top_n")
def _(lines):
    grouped = lines.groupBy(F.col("resource.global_name").alias("global_name")).agg(F.sum("cost").alias("cost"))
    top = grouped.orderBy(F.col("cost").desc(), "global_name").limit(20)
    return top.select("global_name", dmoney(F.col("cost")).alias("cost"))


@query("P27_script_parameters")
def _(lines):
    """Parameters of a SQL script as named arguments."""
    return lines.sparkSession.sql(
        """SELECT service.description AS service, count(*) AS lines FROM {lines}
           WHERE to_date(usage_start_time) BETWEEN date_sub(:as_of, :window_days) AND :as_of GROUP BY 1""",
        args={"as_of": AS_OF, "window_days": 30},
        lines=lines,
    )
