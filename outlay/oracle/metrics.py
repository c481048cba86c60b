"""Oracle SQL of the metric queries: plain LAG over whole series."""

from __future__ import annotations

from outlay.oracle.billing import LINES, d, r

ORACLE: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
# What an instant query at that time sees.
ALIVE = f"ts >= {NOW} - INTERVAL 3 DAY AND ts < {NOW}"
BASE = """ev AS (SELECT event_id, ts, user_id, 'main' AS cluster, event_type AS namespace, 'svc' || (user_id % 10) || '-rs' || (user_id % 3) || '-p' || user_id AS pod,
  'svc' || (user_id % 10) AS workload, CASE user_id % 25 WHEN 24 THEN 'POD' WHEN 23 THEN '' ELSE 'app' END AS container, 'node-' || (user_id // 7) AS node, user_id // 7 AS node_no, value,
  time_bucket(INTERVAL 5 MINUTE, ts) AS grid, user_id % 25 NOT IN (23, 24) AS real FROM events)"""
S = "cluster, namespace, pod, container"


def rises(name: str, value: str, where: str = "TRUE") -> str:
    """Every sample with its reset-aware delta over the whole series."""
    return f"""{name} AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS rise FROM (
  SELECT *, LAG(v) OVER (PARTITION BY {S} ORDER BY ts) AS p FROM (SELECT *, CAST({value} AS DOUBLE) AS v FROM ev WHERE {where})))"""


def last(name: str, value: str, keys: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT {keys}, grid, arg_max(CAST({value} AS DOUBLE), ts) AS v FROM ev WHERE {where} GROUP BY ALL)"


MEM = "floor(value) * 1048576.0"
CPU_REQ = "(user_id % 8 + 1) * 0.25"
MEM_REQ = "(user_id % 4 + 1) * 268435456.0"
COUNTS = [
    "container_cpu_usage_seconds_total", "container_memory_working_set_bytes", "kube_pod_container_resource_requests_cpu",
    "kube_pod_container_resource_requests_memory", "container_cpu_cfs_throttled_periods_total", "container_cpu_cfs_periods_total",
    "container_oom_events_total", "kube_pod_container_status_last_terminated_reason", "kube_node_status_allocatable_cpu", "kube_node_status_allocatable_memory",
]
ORACLE["SRC7_metric_samples"] = " UNION ALL ".join(
    f"SELECT '{n}' AS metric, COUNT(*) AS samples, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events" for n in COUNTS
)
ORACLE["T_rate"] = f"WITH {BASE}, {rises('c', 'value', 'real')} SELECT {S}, grid, {r('SUM(rise) / 300.0::DOUBLE', 6)} AS value FROM c GROUP BY ALL"
ORACLE["T_incr"] = f"WITH {BASE}, {rises('c', 'floor(value / 20)')} SELECT {S}, {r('SUM(rise)', 4)} AS increase FROM c GROUP BY ALL"
_MEMP = last("g", MEM, S, "real")
ORACLE["T_qot"] = f"WITH {BASE}, {_MEMP} SELECT {S}, {r('quantile_cont(v, 0.95)', 4)} AS value FROM g GROUP BY ALL"
ORACLE["T_mot"] = f"WITH {BASE}, {_MEMP} SELECT {S}, MAX(v) AS value FROM g GROUP BY ALL"
ORACLE["T_nrp"] = f"WITH {BASE}, {_MEMP} SELECT {S}, quantile_disc(v, 0.95) AS value FROM g GROUP BY ALL"
_TOT = """SELECT 'main' AS cluster, COALESCE(a.grid, q.grid, u.grid) AS grid"""


def totals(alloc: str, req: str, used: str, dig: bool) -> str:
    f = (lambda x: r(x, 4)) if dig else (lambda x: x)
    return f"""WITH {BASE}, {last('n0', alloc, 'node')}, {last('r0', req, S)}, {used},
a AS (SELECT grid, SUM(v) AS v FROM n0 GROUP BY grid), q AS (SELECT grid, SUM(v) AS v FROM r0 GROUP BY grid), u AS (SELECT grid, SUM(v) AS v FROM u0 GROUP BY grid)
{_TOT}, {f('a.v')} AS allocatable, {f('q.v')} AS requested, {f('u.v')} AS used
FROM a FULL JOIN q ON a.grid = q.grid FULL JOIN u ON COALESCE(a.grid, q.grid) = u.grid"""


CPU_USED = f"{rises('c', 'value', 'real')}, u0 AS (SELECT {S}, grid, SUM(rise) / 300.0::DOUBLE AS v FROM c GROUP BY ALL)"
ALLOC_CPU = "((user_id // 7) % 5 + 1) * 24.0"
ORACLE["T1_cpu_totals"] = totals(ALLOC_CPU, CPU_REQ, CPU_USED, True)
ORACLE["T2_memory_totals"] = totals("((user_id // 7) % 5 + 1) * 17179869184.0", MEM_REQ, last("u0", MEM, S, "real"), False)
ORACLE["T3_requested_unused_cpu"] = f"""WITH t AS ({ORACLE['T1_cpu_totals'].replace('WITH ', 'WITH ', 1)}),
x AS (SELECT 1) SELECT cluster, grid, {r('requested - used', 4)} AS unused FROM t WHERE requested IS NOT NULL AND used IS NOT NULL"""
NSU = f"""{BASE}, {rises('c', 'value', 'real')}, cu AS (SELECT namespace, grid, SUM(rise) / 300.0::DOUBLE AS v FROM c GROUP BY ALL),
{last('mu0', MEM, S, 'real')}, {last('cr0', CPU_REQ, S)}, {last('mr0', MEM_REQ, S)},
mu AS (SELECT namespace, grid, SUM(v) AS v FROM mu0 GROUP BY ALL), cr AS (SELECT namespace, grid, SUM(v) AS v FROM cr0 GROUP BY ALL), mr AS (SELECT namespace, grid, SUM(v) AS v FROM mr0 GROUP BY ALL)"""
J = "JOIN {b} USING (namespace, grid)"
ORACLE["T4_unused_cpu_by_namespace"] = f"WITH {NSU} SELECT namespace, grid, {r('GREATEST(cr.v - cu.v, 0)', 4)} AS unused FROM cr JOIN cu USING (namespace, grid)"
ORACLE["T5_unused_memory_by_namespace"] = f"WITH {NSU} SELECT namespace, grid, GREATEST(mr.v - mu.v, 0.0::DOUBLE) AS unused FROM mr JOIN mu USING (namespace, grid)"
ORACLE["T6_cpu_utilisation"] = f"WITH {NSU} SELECT namespace, grid, {r('100 * (cu.v / cr.v)', 4)} AS utilisation_pct FROM cr JOIN cu USING (namespace, grid)"
ORACLE["T7_memory_utilisation"] = f"WITH {NSU} SELECT namespace, grid, {r('100 * (mu.v / mr.v)', 4)} AS utilisation_pct FROM mr JOIN mu USING (namespace, grid)"
ORACLE["T10_request_cost"] = f"WITH {NSU} SELECT namespace, grid, {r('(cr.v * 0.0242::DOUBLE + mr.v / 1073741824.0::DOUBLE * 0.0032::DOUBLE) * 730::DOUBLE')} AS monthly_cost FROM cr JOIN mr USING (namespace, grid)"
ORACLE["T11_waste_cost"] = f"""WITH {NSU} SELECT namespace, grid, {r('(GREATEST(cr.v - cu.v, 0) * 0.0242::DOUBLE + GREATEST(mr.v - mu.v, 0) / 1073741824.0::DOUBLE * 0.0032::DOUBLE) * 730::DOUBLE')} AS monthly_waste
FROM cr JOIN cu USING (namespace, grid) JOIN mr USING (namespace, grid) JOIN mu USING (namespace, grid)"""
ORACLE["T8_throttling_top"] = f"""WITH {BASE}, {rises('t', 'floor(value / 3)', f"ts >= {NOW} - INTERVAL 9 DAY AND ts < {NOW}")}, {rises('p', 'value', f"ts >= {NOW} - INTERVAL 9 DAY AND ts < {NOW}")},
tg AS (SELECT {S}, grid, SUM(rise) AS v FROM t GROUP BY ALL), pg AS (SELECT {S}, grid, SUM(rise) AS v FROM p GROUP BY ALL),
q AS (SELECT namespace, pod, container, {r('quantile_cont(tg.v / NULLIF(pg.v, 0), 0.95)', 6)} AS throttled_p95 FROM tg JOIN pg USING ({S}, grid)
  WHERE grid >= {NOW} - INTERVAL 2 DAY GROUP BY ALL)
SELECT 'main' AS cluster, * FROM q WHERE throttled_p95 IS NOT NULL ORDER BY throttled_p95 DESC, namespace, pod, container LIMIT 15"""
ORACLE["T9_oom_counts"] = f"""WITH {BASE}, {rises('t', 'floor(value / 10)', f"ts >= {NOW} - INTERVAL 5 DAY AND ts < {NOW}")}
SELECT namespace, container, {r('SUM(rise)', 4)} AS oom_kills FROM t GROUP BY ALL"""
ORACLE["T12_spot_share"] = f"""WITH n AS (SELECT DISTINCT user_id FROM events WHERE {ALIVE}) SELECT CASE user_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS spot, COUNT(*) AS nodes FROM n GROUP BY ALL"""
_PDB = f"""b AS (SELECT 'main' AS cluster, event_type AS namespace, 'pdb-' || user_id AS pdb, arg_max(event_id % 3, ts) AS allowed FROM events WHERE {ALIVE} GROUP BY ALL)"""
ORACLE["T13_blocking_budgets"] = f"WITH {_PDB} SELECT cluster, namespace, pdb FROM b WHERE allowed = 0"
ORACLE["T13_blocking_budget_count"] = f"WITH {_PDB} SELECT COUNT(*) AS blocking FROM b WHERE allowed = 0"
ORACLE["T14_label_values"] = """SELECT 'cluster' AS label, 'main' AS label_value FROM (SELECT 1 FROM events LIMIT 1) UNION ALL SELECT DISTINCT 'namespace', event_type FROM events"""
ORACLE["T15_rightsizing_candidates"] = f"""WITH {NSU.replace('INTERVAL 5 MINUTE', 'INTERVAL 1 HOUR').replace('300.0::DOUBLE', '3600.0::DOUBLE')},
dly AS (SELECT namespace, CAST(grid AS DATE) AS day, MAX(100 * cu.v / cr.v) AS cpu, MAX(100 * mu.v / mr.v) AS mem
  FROM cr JOIN mr USING (namespace, grid) LEFT JOIN cu USING (namespace, grid) LEFT JOIN mu USING (namespace, grid)
  WHERE grid >= {NOW} - INTERVAL 7 DAY AND grid < {NOW} GROUP BY ALL),
n AS (SELECT namespace, {r('MAX(cpu)', 4)} AS cpu_max_pct, {r('MAX(mem)', 4)} AS mem_max_pct, COUNT(cpu) = 7 AND MAX(cpu) < 40 AS cpu_candidate, COUNT(mem) = 7 AND MAX(mem) < 40 AS mem_candidate FROM dly GROUP BY namespace)
SELECT * FROM n WHERE cpu_candidate OR mem_candidate"""
ORACLE["D13_scale_down_nodes"] = f"""WITH {BASE}, req AS (SELECT node, node_no, {S}, {CPU_REQ} AS c, {MEM_REQ} AS m FROM ev WHERE {ALIVE} GROUP BY ALL),
n AS (SELECT 'main' AS cluster, node, {r('SUM(c) / ((node_no % 5 + 1) * 24.0)', 4)} AS cpu_ratio, {r('SUM(m) / ((node_no % 5 + 1) * 17179869184.0)', 4)} AS mem_ratio FROM req GROUP BY node, node_no)
SELECT * FROM n WHERE cpu_ratio < 0.5 AND mem_ratio < 0.5"""
_IN = f"ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW}"
K = "namespace, pod, container"
ORACLE["K1_usage_from_samples"] = f"""WITH {BASE}, {rises('c', 'value', f'real AND {_IN}')}, {rises('t', 'floor(value / 3)', _IN)}, {rises('p', 'value', _IN)}, {rises('o', 'floor(value / 20)', _IN)},
cg AS (SELECT {K}, grid, SUM(rise) / 300.0::DOUBLE AS v FROM c GROUP BY ALL), tg AS (SELECT {K}, grid, SUM(rise) AS v FROM t GROUP BY ALL), pg AS (SELECT {K}, grid, SUM(rise) AS v FROM p GROUP BY ALL),
{last('mg', MEM, K, f'real AND {_IN}')},
cs AS (SELECT {K}, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, MAX(v) AS mx FROM cg GROUP BY ALL),
ts AS (SELECT {K}, quantile_cont(tg.v / NULLIF(pg.v, 0), 0.95) AS thr FROM tg JOIN pg USING ({K}, grid) GROUP BY ALL),
ms AS (SELECT {K}, quantile_cont(v, 0.99) AS m99, MAX(v) AS mx FROM mg GROUP BY ALL),
os AS (SELECT {K}, SUM(rise) AS oom FROM o GROUP BY ALL),
now AS (SELECT DISTINCT {K}, {CPU_REQ} AS cr, {MEM_REQ} AS mr FROM ev WHERE {ALIVE}),
rq AS (SELECT * FROM (SELECT DISTINCT {K}, workload FROM ev WHERE {_IN}) LEFT JOIN now USING ({K}))
SELECT namespace, workload, container, CAST(COUNT(cr) AS INTEGER) AS replicas, {r('MAX(p95) * 1000', 4)} AS cpu_p95_m, {r('MAX(p99) * 1000', 4)} AS cpu_p99_m, {r('MAX(cs.mx) * 1000', 4)} AS cpu_max_m,
  {r('MAX(m99) / 1048576.0::DOUBLE', 4)} AS mem_p99_mi, {r('MAX(ms.mx) / 1048576.0::DOUBLE', 4)} AS mem_max_mi, {r('MAX(cr) * 1000', 4)} AS cpu_request_m, {r('MAX(mr) / 1048576.0::DOUBLE', 4)} AS mem_request_mi,
  {r('COALESCE(MAX(thr), 0)', 4)} AS throttled_ratio_p95, {r('COALESCE(MAX(oom), 0)', 4)} AS oom_kills_14d
FROM rq LEFT JOIN cs USING ({K}) LEFT JOIN ts USING ({K}) LEFT JOIN ms USING ({K}) LEFT JOIN os USING ({K}) GROUP BY ALL HAVING MAX(p95) IS NOT NULL AND MAX(cr) > 0"""

AGG = {"min": "MIN(value)", "max": "MAX(value)", "mean": "AVG(value)", "p50": "quantile_cont(value, 0.5)", "delta": "SUM(value)", "rate": "SUM(value) / 3600.0::DOUBLE"}
RED = {"max": "MAX(v)", "mean": "AVG(v)", "sum": "SUM(v)"}
FIELDS = {
    "instance": "'instance-' || (user_id % 40)", "cluster": "'cluster-' || (user_id % 3)", "namespace": "event_type", "database": "'db-' || (user_id % 12)",
    "storage_class": "CASE user_id % 4 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'NEARLINE' WHEN 2 THEN 'COLDLINE' ELSE 'ARCHIVE' END",
}


def chart(minutes: int, aligner: str, reducer: str, field: str | None) -> str:
    expr = f"{FIELDS[field]} AS {field}," if field else ""
    extra = f"{field}, " if field else ""
    return f"""WITH a AS (SELECT user_id AS series, event_type AS et, {expr} time_bucket(INTERVAL {minutes} MINUTE, ts) AS period, {AGG[aligner]} AS v FROM events GROUP BY ALL)
SELECT {extra}period, {r(RED[reducer], 4)} AS value FROM a GROUP BY ALL"""


for _n, _a in {
    "A0_align_reduce": (30, "min", "max", "namespace"), "A1_instance_cpu": (60, "p50", "mean", "instance"), "A2_allocatable_cores": (60, "mean", "sum", "cluster"),
    "A3_cpu_request_utilisation": (60, "mean", "mean", "namespace"), "A4_memory_request_utilisation": (60, "mean", "mean", "namespace"),
    "A5_sql_connections": (60, "max", "max", "database"), "A6_cache_usage": (60, "mean", "mean", "instance"), "A7_scanned_bytes": (60, "delta", "sum", None),
    "A8_bytes_by_class": (60, "mean", "sum", "storage_class"), "A9_sent_bytes": (60, "rate", "sum", "instance"),
}.items():
    ORACLE[_n] = chart(*_a)
ORACLE["A10_cost_scorecard"] = f"""WITH {LINES}, a AS (SELECT COALESCE(project_id, '(account)') AS p, usage_date, MAX(net) AS v FROM lines GROUP BY ALL),
s AS (SELECT CAST(usage_date AS TIMESTAMP) AS period, SUM(v) AS v FROM a GROUP BY ALL)
SELECT period, {d('v')} AS value, CASE WHEN v >= 800 THEN 'RED' WHEN v >= 500 THEN 'YELLOW' ELSE 'GREEN' END AS band FROM s"""
