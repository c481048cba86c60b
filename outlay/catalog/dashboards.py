"""Dashboard, KPI and budget queries over the stored tables."""

from __future__ import annotations

from outlay.binding import tables as b
from outlay.operators import billing
from outlay.operators import dashboards as d
from outlay.plans import budgets

AS_OF = b.AS_OF
BUDGET = 500_000.0
QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("L1_overview")
def _(spark, sf):
    return d.overview(b.billing(spark, sf), AS_OF)


@query("L2_cost_per_day")
def _(spark, sf):
    return d.cost_per_day(b.billing(spark, sf), AS_OF)


@query("L3_showback_pivot")
def _(spark, sf):
    return d.showback_pivot(b.billing(spark, sf), AS_OF)


@query("L3_top_projects")
def _(spark, sf):
    return d.top_projects(b.billing(spark, sf), AS_OF)


@query("L3_unlabelled_by_project")
def _(spark, sf):
    return d.unlabelled_by_project(b.billing(spark, sf), AS_OF)


@query("L4_unallocated_share")
def _(spark, sf):
    return d.unallocated_share(b.billing(spark, sf), AS_OF)


@query("L5_commitment_trend")
def _(spark, sf):
    return d.commitment_trend(b.billing(spark, sf), AS_OF)


@query("D1_unlabelled_kpi")
def _(spark, sf):
    return d.unlabelled_kpi(b.billing(spark, sf), AS_OF)


@query("D2_unit_cost")
def _(spark, sf):
    return d.unit_cost(b.billing(spark, sf), b.business_metrics(spark, sf), AS_OF)


@query("D3_team_cost")
def _(spark, sf):
    return d.team_cost(b.billing(spark, sf), b.namespace_teams(spark, sf), AS_OF)


@query("D4_commitment_size")
def _(spark, sf):
    return d.commitment_size(b.billing(spark, sf, hourly=True), AS_OF)


@query("D5_commitment_health")
def _(spark, sf):
    return d.commitment_health(billing.commitment_coverage(b.billing(spark, sf), AS_OF))


@query("D7_arrival_lag")
def _(spark, sf):
    return d.arrival_lag(b.billing(spark, sf), settle_days=2)


@query("D9_off_hours_share")
def _(spark, sf):
    return d.off_hours_share(b.billing(spark, sf, hourly=True), AS_OF)


@query("S3_budget_alerts")
def _(spark, sf):
    """Alerts of the day, without those that had fired five days before."""
    lines = b.billing(spark, sf)
    day_before = AS_OF.replace(day=AS_OF.day - 5)
    fired = budgets.budget_alerts(budgets.month_to_date(lines, day_before), BUDGET)
    keys = ["month", "project_id", "basis", "threshold"]
    return budgets.budget_alerts(budgets.month_to_date(lines, AS_OF), BUDGET, fired.select(*keys))
