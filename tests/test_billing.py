"""Traps of the billing queries on small hand-written lines."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outlay import schemas
from outlay.operators import anomalies, billing, dashboards
from outlay.sources.billing import billing_scan

AS_OF = dt.date(2026, 9, 21)


def line(day=dt.date(2026, 9, 20), cost="10", credits=(), service="Compute Engine", sku="N2 Instance Core", project="p1", **kw):
    start = dt.datetime.combine(day, dt.time(kw.pop("hour", 0)))
    row = dict(
        ingest_date=kw.pop("ingest", day), usage_start_time=start, usage_end_time=start, export_time=start,
        invoice={"month": day.strftime("%Y%m")},
        project={"id": project, "name": None, "number": None, "labels": kw.pop("plabels", [])},
        labels=kw.pop("labels", []), system_labels=kw.pop("slabels", []),
        resource={"name": "d", "global_name": kw.pop("gname", None)},
        service={"description": service}, sku={"id": "s", "description": sku},
        location={"region": "r1", "zone": "r1-a"}, cost=Decimal(cost),
        credits=None if credits is None else [dict(name=t, full_name=t, id=t, type=t, amount=None if a is None else Decimal(a)) for t, a in credits],
        cost_type=kw.pop("cost_type", "regular"),
        usage={"amount": 1.0, "unit": "s", "amount_in_pricing_units": kw.pop("qty", 1.0), "pricing_unit": kw.pop("unit", "hour")},
        currency="USD", currency_conversion_rate=1.0, cost_at_list=Decimal(cost), price={"effective_price": 1.0},
    )
    assert not kw, kw
    return row


def label(**kw):
    return [{"key": k.replace("_", "-"), "value": v} for k, v in kw.items()]


@pytest.fixture
def lines(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.BILLING_LINE)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


@pytest.mark.parametrize(
    "credits, net",
    [(None, 10), ([], 10), ([("A", "-1")], 9), ([("A", "-1"), ("B", "-2")], 7), ([("A", None)], 10), ([("A", "-1")] * 6, 4)],
)
def test_net_cost(lines, credits, net):
    assert one(lines(line(credits=credits)).select(billing.line_net().alias("n")))["n"] == net


def test_typed_credits_in_long_and_short_arrays(lines):
    mixed = [("COMMITTED_USAGE_DISCOUNT", "-1"), ("SUSTAINED_USAGE_DISCOUNT", "-2")]
    for copies in (1, 4):
        row = one(billing.commitment_lines(lines(line(credits=mixed * copies))))
        assert (row["cud"], row["sud"]) == (-copies, -2 * copies)


def test_view_shows_null_without_credits(lines):
    got = billing.v_cost_daily(lines(line(credits=[]), line(credits=None), line(credits=[("A", "-1")])))
    assert sorted(str(r["credits"] and float(r["credits"])) for r in got.collect()) == ["-1.0", "None", "None"]


def test_view_uses_the_local_day(lines):
    row = one(billing.v_cost_daily(lines(line(hour=19))))
    assert row["usage_date"] == dt.date(2026, 9, 21)


def test_view_by_name(spark, lines):
    billing.register_cost_view(lines(line(labels=label(app="a"))))
    assert spark.sql("SELECT app, k8s_namespace FROM v_cost_daily").first() == ("a", None)


def test_scan_bounds(lines):
    d = lambda n: AS_OF - dt.timedelta(days=n)
    kept = [line(day=d(30)), line(day=d(0)), line(day=d(30), ingest=d(27))]
    dropped = [
        line(day=d(31)), line(cost_type="tax"), line(day=d(30), ingest=d(34)), line(day=d(-1)), line(day=d(5), ingest=d(-1)),
    ]
    assert billing_scan(lines(*kept, *dropped), AS_OF, 30).count() == 3


def test_window_border_day_belongs_to_the_current_window(lines):
    row = one(billing.cost_by_service(lines(line(day=AS_OF - dt.timedelta(days=30)), line(day=AS_OF - dt.timedelta(days=31), cost="4")), AS_OF))
    assert (row["current_30d"], row["previous_30d"], row["delta_pct"], row["share_pct"]) == (10.0, 4.0, 150.0, 100.0)


def test_showback_fallbacks_and_rounded_having(lines):
    rows = billing.cost_by_label(
        lines(
            line(plabels=label(env="prod"), labels=label(env="dev", team="x", cost_center="cc-9"), project=None),
            line(cost="0.004", project="tiny"),
            line(cost="30", labels=[{"key": "team", "value": "a"}, {"key": "team", "value": "b"}]),
        ),
        AS_OF,
    ).collect()
    by = {r["project_id"]: r for r in rows}
    assert set(by) == {"(account)", "p1"}
    acc = by["(account)"]
    # The cost centre is never read from the resource labels.
    assert (acc["env"], acc["team"], acc["cost_center"], acc["share_of_month_pct"]) == ("prod", "x", "(unlabelled)", 25.0)
    assert by["p1"]["team"] == "a"


def test_share_with_null_group_key(lines):
    cl = [{"key": "goog-k8s-cluster-name", "value": "c"}]
    rows = billing.cost_by_namespace(lines(line(labels=cl, project=None), line(labels=cl, project=None, sku="Spot Core")), AS_OF).collect()
    assert sorted((r["pricing_model"], r["share_of_cluster_pct"], r["namespace"]) for r in rows) == [
        ("on-demand", 50.0, "(unallocated)"), ("spot", 50.0, "(unallocated)"),
    ]


USED_AND_FEE = [
    line(cost="100", credits=[("COMMITTED_USAGE_DISCOUNT", "-60")], slabels=[{"key": "compute.googleapis.com/machine_spec", "value": "n2-standard-4"}]),
    line(cost="80", sku="Commitment v1: Cpu for 1 Year"),
]


def test_commitment_fee_without_machine_spec(lines):
    rows = billing.commitment_coverage(lines(*USED_AND_FEE, line(cost="0.001", sku="Something else")), AS_OF).collect()
    by = {r["machine_family"]: r for r in rows}
    assert by["n2"]["cud_coverage_pct"] == 60.0 and by["n2"]["idle_cud_cost"] == 0.0
    assert by["unknown"]["commitment_fees"] == 80.0 and by["unknown"]["idle_cud_cost"] == 80.0
    region = one(billing.commitment_coverage(lines(*USED_AND_FEE), AS_OF, by=("region",)))
    assert (region["commitment_fees"], region["idle_cud_cost"]) == (80.0, 20.0)


def test_credit_share_is_not_fanned_out(lines):
    rows = billing.credits_breakdown(lines(line(cost="100", credits=[("PROMOTION", "-10"), ("X", "-5")]), line(cost="100", credits=None)), AS_OF).collect()
    assert {r["credit_type"]: (r["pct_of_month_list_cost"], r["meaning"][:5]) for r in rows} == {"PROMOTION": (5.0, "Promo"), "X": (2.5, "n/a")}


@pytest.mark.parametrize(
    "sku, cls",
    [
        ("Network Internet Egress", "internet"), ("Egress to Australia", "internet"), ("Network Inter-Region Egress", "inter-region"),
        ("Network Inter Zone Egress", "inter-zone"), ("CDN Egress", "cdn-cache-egress"), ("VPN Egress", "hybrid"), ("Egress", "other-network"),
    ],
)
def test_egress_classes(lines, sku, cls):
    assert one(billing.egress_cost(lines(line(sku=sku, unit="gibibyte")), AS_OF))["egress_class"] == cls


def test_egress_group_of_one_unit_is_dropped_before_the_share(lines):
    row = one(billing.egress_cost(lines(line(cost="1.004", sku="Egress", unit="gibibyte", project="a"), line(cost="9", sku="Egress", unit="gibibyte")), AS_OF))
    assert row["share_pct"] == 100.0


def test_latest_asset_version_decides(spark, lines):
    name = "//compute.googleapis.com/projects/p/zones/z/disks/d"
    t = lambda d: dt.datetime(2026, 9, d)
    assets = lambda *docs: spark.createDataFrame([(name, t(i), {"data": x}) for i, x in enumerate(docs, 1)], schemas.ASSET)
    bill = lines(line(sku="Storage PD Capacity", gname=name))
    free, used = '{"labels":{"keep":"true"},"lastDetachTimestamp":"2026-09-11T05:00:00Z"}', '{"users":["vm"]}'
    row = one(billing.unattached_disk_cost(bill, assets(used, free), AS_OF))
    assert (row["days_unattached"], row["excluded_by_label"]) == (10, True)
    assert billing.unattached_disk_cost(bill, assets(free, used), AS_OF).count() == 0
    offset = '{"lastDetachTimestamp":"2026-09-10T20:00:00.000-07:00"}'
    assert one(billing.unattached_disk_cost(bill, assets(offset), AS_OF))["days_unattached"] == 10
    odd = '{"lastDetachTimestamp":"soon"}'
    assert one(billing.unattached_disk_cost(bill, assets(odd), AS_OF))["days_unattached"] is None


def series(lines, costs, last):
    """Daily costs ending on the scored day."""
    target = AS_OF - dt.timedelta(days=2)
    rows = [line(day=target - dt.timedelta(days=i), cost=str(c)) for i, c in enumerate([last, *costs])]
    return lines(*rows)


def test_spike_and_zero_variance(lines):
    noisy = [100 + i % 3 for i in range(30)]
    row = one(anomalies.daily_anomalies(series(lines, noisy, 400), AS_OF))
    assert (row["direction"], row["abs_delta"], row["baseline_mean"]) == ("spike", 299.0, 101.0)
    flat = series(lines, [100] * 30, 400)
    assert anomalies.daily_anomalies(flat, AS_OF).count() == 0
    assert anomalies.daily_anomalies(flat, AS_OF, flag_zero_variance=True).count() == 1
    assert anomalies.daily_anomalies(series(lines, noisy, 140), AS_OF).count() == 0  # below the absolute floor


def test_densify_counts_and_values(spark, frame):
    daily = frame("usage_date date, k string, net_cost decimal(18,4)", (dt.date(2026, 1, 3), "a", Decimal(5)), (dt.date(2026, 1, 5), "a", Decimal(7)), (dt.date(2026, 1, 1), "b", Decimal(1)))
    dense = anomalies.densify_daily(daily, ["k"], F.lit(dt.date(2026, 1, 1)), F.lit(dt.date(2026, 1, 6)))
    got = {(r["k"], r["usage_date"].day): float(r["net_cost"]) for r in dense.collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {("a", 3): 5.0, ("a", 5): 7.0, ("b", 1): 1.0}


def test_commitment_size_against_brute_force(lines):
    rows = [line(day=AS_OF - dt.timedelta(days=d), hour=h, qty=float(d + h)) for d in range(3) for h in range(24) if (d + h) % 5]
    row = one(dashboards.commitment_size(lines(*rows), AS_OF, window_days=2))
    dense = sorted(float(d + h) if (d + h) % 5 else 0.0 for d in range(3) for h in range(24))
    at = 0.05 * 71
    assert row["commit_usage"] == pytest.approx(dense[int(at)] + (dense[int(at) + 1] - dense[int(at)]) * (at % 1), abs=1e-4)
    assert (row["hours"], row["hours_with_usage"]) == (72, len(rows))


def test_net_is_cost_plus_credits_and_shares_sum_up(lines):
    rows = billing.cost_by_service(lines(line(cost="33"), line(cost="33", service="B"), line(cost="34", service="C")), AS_OF).collect()
    assert sum(r["share_pct"] for r in rows) == pytest.approx(100, abs=0.2)


def test_tiny_amounts_are_not_lost(lines):
    many = lines(line(cost="0.00004")).select("*", F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("n"))
    assert one(many.agg(F.sum(billing.line_net()).alias("n")))["n"] == Decimal(4)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 20])
def test_credits_add_up_alike_at_every_length(lines, n):
    credits = [("PROMOTION", "-0.00004")] * n + [("PROMOTION", None)]
    df = lines(line(credits=credits))
    want = Decimal("-0.00004") * n
    assert one(df.select(billing.fold_credits(F.col("credits")).alias("x")))["x"] == want
    assert one(df.select(billing.credits_of_type(F.col("credits"), "PROMOTION").alias("x")))["x"] == want


def test_back_fill_equals_the_daily_run(lines):
    days = [AS_OF - dt.timedelta(days=d) for d in range(80)]
    rows = [line(day=d, cost=str(1000 if i in (2, 20, 45) else 100 + i % 3), project=p) for i, d in enumerate(days) for p in ("p1", "p2") if p == "p1" or i < 50]
    df = lines(*rows)
    for since in (days[46], days[21], days[4]):
        filled = {tuple(r) for r in anomalies.daily_anomalies(df, AS_OF, score_since=since).collect()}
        for day in (days[45], days[20], days[2], days[30]):
            daily = {tuple(r) for r in anomalies.daily_anomalies(df, day + dt.timedelta(days=2)).collect()}
            assert daily == {r for r in filled if r[0] == day} or day < since
    assert len(filled) and anomalies.daily_anomalies(df, AS_OF, score_since=days[21]).filter(F.col("usage_date") == days[20]).count() == 2
