"""Oracle SQL of the dashboard, KPI and budget queries."""

from __future__ import annotations

from outlay.oracle.billing import (
    AS_OF, COMMITMENT_COLUMNS, ELIGIBLE, LINES, MONTH_BOUNDS, commitment_cte, d, div, r, window_bounds,
)

ORACLE: dict[str, str] = {}


def since(first: str, last: str = AS_OF) -> str:
    return f"cost_type = 'regular' AND ingest_date BETWEEN {first} AND {last} AND usage_date BETWEEN {first} AND {last}"


CREDIT = "(COALESCE(c1_amount, 0) + COALESCE(c2_amount, 0))"
JUNE = "usage_date >= DATE '2000-06-01'"
ORACLE["L1_overview"] = f"""WITH {LINES}, s AS (SELECT SUM(CASE WHEN {JUNE} THEN net ELSE 0 END) AS mtd, SUM(CASE WHEN {JUNE} THEN 0 ELSE net END) AS lm,
  SUM(CASE WHEN {JUNE} THEN {CREDIT} ELSE 0 END) AS cr FROM lines WHERE {since("DATE '2000-05-01'")})
SELECT {d('mtd')} AS mtd_net_cost, {r('CAST(mtd AS DOUBLE) / 24 * 30')} AS mtd_forecast, {d('lm')} AS last_month_net_cost, {r(div('mtd - lm', 'lm') + ' * 100', 1)} AS mom_pct, {d('cr')} AS mtd_credits FROM s"""
ORACLE["L2_cost_per_day"] = f"WITH {LINES} SELECT usage_date, service, {d('SUM(net)')} AS net_cost FROM lines WHERE {window_bounds(30)} GROUP BY ALL"
TEAM = "COALESCE(p_team, r_team, '(unlabelled)')"
ENV = "COALESCE(p_env, r_env, '(unlabelled)')"
ORACLE["L3_showback_pivot"] = f"""WITH {LINES} SELECT {TEAM} AS team, COALESCE(p_cc, '(unlabelled)') AS cost_center,
  {', '.join(f"{d(f'COALESCE(SUM(net) FILTER ({ENV} = {chr(39)}{e}{chr(39)}), 0)')} AS cost_{e.strip('()')}" for e in ('dev', 'uat', 'prod', '(unlabelled)'))}
FROM lines WHERE {MONTH_BOUNDS} GROUP BY ALL"""
ORACLE["L3_top_projects"] = f"""WITH {LINES}, g AS (SELECT COALESCE(project_id, '(account)') AS project_id, SUM(net) AS net FROM lines WHERE {MONTH_BOUNDS} GROUP BY ALL)
SELECT project_id, {d('net')} AS net_cost FROM g ORDER BY net DESC, project_id LIMIT 10"""
ORACLE["L3_unlabelled_by_project"] = f"WITH {LINES} SELECT COALESCE(project_id, '(account)') AS project_id, {d('SUM(net)')} AS unlabelled_cost FROM lines WHERE {MONTH_BOUNDS} AND p_team IS NULL AND r_team IS NULL GROUP BY ALL"
CLUSTERED = f"{window_bounds(30)} AND service IN ('Compute Engine', 'Kubernetes Engine') AND cluster IS NOT NULL"
ORACLE["L4_unallocated_share"] = f"""WITH {LINES}, g AS (SELECT project_id, cluster, SUM(net) AS net, SUM(CASE WHEN ns IS NULL THEN net ELSE 0 END) AS idle FROM lines WHERE {CLUSTERED} GROUP BY ALL)
SELECT project_id, cluster, {d('net')} AS net_cost, {r(div('idle', 'net') + ' * 100', 1)} AS unallocated_pct FROM g"""
ORACLE["L5_commitment_trend"] = f"WITH {LINES}, {commitment_cte(MONTH_BOUNDS, 'invoice_month, region')} SELECT invoice_month, region, {COMMITMENT_COLUMNS} FROM sums"
ORACLE["D1_unlabelled_kpi"] = f"""WITH {LINES}, g AS (SELECT invoice_month, SUM(net) AS net, SUM(CASE WHEN p_team IS NULL AND r_team IS NULL THEN net ELSE 0 END) AS u FROM lines WHERE {MONTH_BOUNDS} GROUP BY ALL)
SELECT invoice_month, {d('net')} AS net_cost, {r(div('u', 'net') + ' * 100', 2)} AS unlabelled_pct, CASE WHEN {div('u', 'net')} * 100 < 2.0 THEN 'ok' ELSE 'above target' END AS status FROM g"""
ORACLE["D2_unit_cost"] = f"""WITH {LINES}, g AS (SELECT app, usage_date AS date, SUM(net) AS net FROM lines WHERE {window_bounds(30)} AND app IS NOT NULL GROUP BY ALL),
u AS (SELECT 'app-' || (o_custkey % 7) AS app, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS units FROM orders GROUP BY ALL)
SELECT app, date, {d('net')} AS net_cost, units, {r(div('net', 'units'), 4)} AS cost_per_unit FROM g JOIN u USING (app, date)"""
ORACLE["D3_team_cost"] = f"""WITH {LINES}, m AS (SELECT 'ns-' || r_regionkey AS ns, 'team-' || (r_regionkey % 3) AS team FROM region),
g AS (SELECT COALESCE(team, '(unmapped)') AS team, SUM(net) AS net FROM lines LEFT JOIN m USING (ns) WHERE {CLUSTERED} GROUP BY ALL) SELECT team, {d('net')} AS net_cost FROM g"""
ORACLE["D4_commitment_size"] = f"""WITH {LINES}, h AS (SELECT family, region, date_trunc('hour', usage_hour_ts) AS hour, SUM(qty) AS amount FROM lines
  WHERE {window_bounds(90)} AND service = 'Compute Engine' AND {ELIGIBLE} GROUP BY ALL),
cal AS (SELECT UNNEST(generate_series(CAST({AS_OF} - 90 AS TIMESTAMP), CAST({AS_OF} AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hour),
dense AS (SELECT k.family, k.region, cal.hour, h.amount FROM cal CROSS JOIN (SELECT DISTINCT family, region FROM h) k LEFT JOIN h ON h.family = k.family AND h.region = k.region AND h.hour = cal.hour)
SELECT family AS machine_family, region, CAST(COUNT(*) AS INTEGER) AS hours, COUNT(amount) AS hours_with_usage, {r('SUM(COALESCE(amount, 0)) / COUNT(*)', 4)} AS mean_usage, {r('quantile_cont(COALESCE(amount, 0), 0.05)', 4)} AS commit_usage
FROM dense GROUP BY ALL"""
ORACLE["D5_commitment_health"] = f"""WITH {LINES}, {commitment_cte(window_bounds(30), 'region, family')}, c AS (SELECT region, family AS machine_family, {COMMITMENT_COLUMNS} FROM sums),
u AS (SELECT *, {div('LEAST(cud_credit_applied, commitment_fees)', 'commitment_fees')} * 100 AS util FROM c)
SELECT region, machine_family, cud_coverage_pct, {r('util', 1)} AS utilisation_pct,
  CASE WHEN cud_coverage_pct > 90 THEN 'inflexible' WHEN cud_coverage_pct > 80 THEN 'high' WHEN cud_coverage_pct >= 60 THEN 'healthy' WHEN cud_coverage_pct IS NOT NULL THEN 'low' ELSE 'no usage' END AS coverage_band,
  CASE WHEN util > 95 THEN 'healthy' WHEN util IS NOT NULL THEN 'idle' ELSE 'no commitment' END AS utilisation_band FROM u"""
ORACLE["D7_arrival_lag"] = f"WITH {LINES} SELECT CAST(CAST(export_ts AS DATE) - usage_date AS INTEGER) AS lag_days, COUNT(*) AS lines, {d('SUM(cost)')} AS cost, CAST(export_ts AS DATE) - usage_date > 2 AS beyond_horizon FROM lines GROUP BY ALL"
LOCAL = "(usage_hour_ts + INTERVAL 330 MINUTE)"
ORACLE["D9_off_hours_share"] = f"""WITH {LINES}, g AS (SELECT {ENV} AS env, SUM(net) AS net,
  SUM(CASE WHEN isodow({LOCAL}) <= 5 AND hour({LOCAL}) BETWEEN 8 AND 19 THEN 0 ELSE net END) AS off FROM lines WHERE {window_bounds(30)} GROUP BY ALL)
SELECT env, {d('net')} AS net_cost, {d('off')} AS off_hours_cost, {r(div('off', 'net') + ' * 100', 1)} AS off_hours_pct FROM g"""


def alerts(name: str, last: str, day: int) -> str:
    return f"""{name}_s AS (SELECT '200006' AS month, COALESCE(project_id, '(account)') AS project_id, SUM(net) AS actual, CAST(SUM(net) AS DOUBLE) / {day} * 30 AS forecast
  FROM lines WHERE {since("DATE '2000-06-01'", last)} GROUP BY ALL),
{name} AS (SELECT * FROM {name}_s, (VALUES ('actual', 0.5::DOUBLE), ('actual', 0.8::DOUBLE), ('actual', 0.9::DOUBLE), ('actual', 1.0::DOUBLE), ('forecast', 1.0::DOUBLE), ('forecast', 1.2::DOUBLE)) t(basis, threshold)
  WHERE CASE WHEN basis = 'actual' THEN CAST(actual AS DOUBLE) ELSE forecast END >= threshold * 500000.0::DOUBLE)"""


ORACLE["S3_budget_alerts"] = f"""WITH {LINES}, {alerts('b1', "DATE '2000-06-19'", 19)}, {alerts('b2', AS_OF, 24)}
SELECT month, project_id, basis, threshold, {d('actual')} AS actual_cost, {r('forecast')} AS forecast_cost FROM b2
WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.project_id = b2.project_id AND b1.basis = b2.basis AND b1.threshold = b2.threshold)"""
