"""Oracle SQL of the streaming and sink queries: over the whole input; rollups of its closed windows."""

from __future__ import annotations

from outlay.oracle.billing import AS_OF, LINES, anomalies, d, r
from outlay.oracle.inventory import ORACLE as INVENTORY
from outlay.oracle.metrics import ORACLE as METRICS

CLOSED = "usage_date + 1 <= (SELECT MAX(usage_date) FROM reg) - 3"
REG = "reg AS (SELECT *, COALESCE(project_id, '(account)') AS pid FROM lines WHERE cost_type = 'regular')"
ORACLE: dict[str, str] = {
    "S1_daily_rollup_stream": f"WITH {LINES}, {REG} SELECT usage_date, pid AS project_id, service, {d('SUM(net)')} AS net_cost FROM reg WHERE {CLOSED} GROUP BY ALL",
    "S2_spend_alerts_stream": f"WITH {LINES}, {REG} SELECT usage_date, pid AS project_id, {d('SUM(net)')} AS net_cost FROM reg GROUP BY ALL HAVING SUM(net) > 500",
    "S3_budget_alerts_stream": f"""WITH {LINES}, {REG},
s AS (SELECT invoice_month AS month, pid AS project_id, SUM(net) AS actual, CAST(SUM(net) AS DOUBLE) / day(MAX(usage_date)) * day(last_day(MAX(usage_date))) AS forecast FROM reg GROUP BY ALL)
SELECT month, project_id, basis, threshold, {d('actual')} AS actual_cost, {r('forecast')} AS forecast_cost
FROM s, (VALUES ('actual', 0.5::DOUBLE), ('actual', 0.8::DOUBLE), ('actual', 0.9::DOUBLE), ('actual', 1.0::DOUBLE), ('forecast', 1.0::DOUBLE), ('forecast', 1.2::DOUBLE)) t(basis, threshold)
WHERE CASE WHEN basis = 'actual' THEN CAST(actual AS DOUBLE) ELSE forecast END >= threshold * 500000.0::DOUBLE""",
    "S4_align_reduce_stream": f"""WITH a AS (SELECT user_id, event_type AS namespace, time_bucket(INTERVAL 1 HOUR, ts) AS period, AVG(value) AS v FROM events GROUP BY ALL)
SELECT namespace, period, {r('SUM(v)', 4)} AS value FROM a WHERE period + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""",
    "T_rate_stream": f"SELECT * FROM ({METRICS['T_rate']}) WHERE grid + INTERVAL 5 MINUTE <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM events)",
    "SNK1_findings_sink": f"SELECT *, {AS_OF} AS run_date FROM ({INVENTORY['I8_all_findings']})",
    "SNK2_run_dated_report": f"SELECT x.*, run_date FROM ({INVENTORY['I11_category_rollup']}) x, (VALUES (DATE '2000-06-17'), ({AS_OF})) t(run_date)",
    "SNK3_anomaly_feed": anomalies(None),
}
