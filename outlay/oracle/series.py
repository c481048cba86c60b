"""Oracle SQL of the stored series: everything computed anew from all lines."""

from __future__ import annotations

from outlay.oracle.billing import AS_OF, LINES, anomalies, d
from outlay.oracle.metrics import _MEMP, BASE, S

ORACLE: dict[str, str] = {
    "S1_restated_rollup": f"""WITH {LINES},
reg AS (SELECT *, COALESCE(project_id, '(account)') AS pid FROM lines WHERE cost_type = 'regular' AND usage_date >= DATE '1999-06-01' AND export_ts < {AS_OF} + 3)
SELECT usage_date, pid AS project_id, service, {d('SUM(net)')} AS net_cost,
  usage_date IN (SELECT usage_date FROM reg WHERE export_ts >= {AS_OF} + 1) AS restated FROM reg GROUP BY usage_date, pid, service""",
    "SNK3_incremental_anomalies": " UNION ALL ".join(
        f"SELECT * FROM ({anomalies(None).replace(AS_OF, f'({AS_OF} - {ago})')})" for ago in range(10)
    ),
    "T_nrp_sketches": f"""WITH {BASE}, {_MEMP} SELECT {S}, MAX(v) AS highest, CASE WHEN COUNT(*) <= 400 THEN quantile_disc(v, 0.95) END AS p95, COUNT(*) AS n, TRUE AS within
FROM g WHERE grid >= DATE '2024-01-17' AND grid < DATE '2024-01-31' GROUP BY ALL""",
}
