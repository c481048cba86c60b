"""Oracle SQL of the inventory, findings and plan queries."""

from __future__ import annotations

from outlay import fixed
from outlay.oracle.billing import r
from outlay.oracle.text import quote, say

NOW = "TIMESTAMP '2000-06-24 02:00:00'"


def pick(index: str, names: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"(CASE {index} {cases} END)"


def age(ts: str) -> str:
    return f"CAST(GREATEST(0, date_sub('day', {ts}, {NOW})) AS INTEGER)"


def kept(k: str) -> str:
    return f"({k} % 11 = 0)"


def labels_json(k: str) -> str:
    return f"""'{{' || CASE WHEN {k} % 11 = 0 THEN '"keep":"' || CASE WHEN {k} % 2 = 0 THEN 'true' ELSE 'True' END || '",' ELSE '' END || '"team":"t' || ({k} % 5) || '"}}'"""


def b(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'true' ELSE 'false' END"


def fbytes(x: str) -> str:
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    cases = " ".join(
        f"WHEN {x} < {1024 ** (i + 1)} THEN format('{{:,.1f}} {u}', CAST({x} AS DOUBLE) / {1024 ** i}.0::DOUBLE)" for i, u in enumerate(units)
    )
    return f"(CASE {cases} ELSE format('{{:,.1f}} PiB', CAST({x} AS DOUBLE) / {1024 ** 5}.0::DOUBLE) END)"


def money(x: str) -> str:
    return f"format('{{:,.2f}} USD', {x})"


DISK_TYPE = pick("p_partkey % 4", ["pd-standard", "pd-balanced", "pd-ssd", "pd-extreme"])


def disk_price(t: str, ssd: float = 0.204) -> str:
    return f"(CASE {t} WHEN 'pd-standard' THEN 0.048::DOUBLE WHEN 'pd-ssd' THEN {ssd}::DOUBLE ELSE 0.12::DOUBLE END)"


def disks(ssd: float = 0.204) -> str:
    monthly = f"(p_size * 10 * {disk_price(DISK_TYPE, ssd)})"
    idle = age(
        f"CASE WHEN p_partkey % 2 = 1 THEN {NOW} - to_days(CAST(p_partkey % 90 AS INTEGER)) - INTERVAL 5 HOUR"
        f" ELSE {NOW} - to_days(CAST(p_partkey % 200 AS INTEGER)) - INTERVAL 1 HOUR END"
    )
    k = kept("p_partkey")
    return f"""SELECT 'unattached-disk' AS category, 'zone-' || (p_partkey % 3) || '/disks/disk-' || p_partkey AS resource,
  CASE WHEN {monthly} > 50 AND NOT {k} THEN 'high' ELSE 'medium' END AS severity, {r(monthly)} AS monthly_cost_estimate,
  CASE WHEN {k} THEN {quote(fixed.EXCLUDED_DISK)}
    ELSE {say(fixed.DISK_TEXT, days=idle, cost=money('p_size * 10 * 0.032::DOUBLE'))} END AS recommendation,
  {k} AS excluded,
  '{{"size_gb":' || (p_size * 10) || ',"type":"' || {DISK_TYPE} || '","idle_days":' || {idle} || ',"excluded":' || {b(k)} || ',"labels":' || {labels_json('p_partkey')} || '}}' AS details
FROM part WHERE p_partkey % 3 <> 0"""


def addresses() -> str:
    k = kept("s_suppkey")
    ip = "'10.0.' || ((s_suppkey // 256) % 256) || '.' || (s_suppkey % 256)"
    days = age(f"{NOW} - to_days(CAST(s_suppkey % 100 AS INTEGER)) - INTERVAL 3 HOUR")
    return f"""SELECT 'idle-static-ip', CASE WHEN s_suppkey % 6 = 0 THEN 'global' ELSE 'region-' || (s_nationkey % 5) END || '/addresses/addr-' || s_suppkey,
  'low', {r('0.012::DOUBLE * 730::DOUBLE')},
  CASE WHEN {k} THEN {quote(fixed.EXCLUDED)} ELSE {say(fixed.ADDRESS_TEXT, address=ip, days=days)} END, {k},
  '{{"address":"' || {ip} || '","excluded":' || {b(k)} || '}}'
FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0"""


def instances(min_days: int = 14, ssd: float = 0.204) -> str:
    def disk(i: int) -> str:
        t = f"CASE (o_orderkey + {i}) % 3 WHEN 0 THEN 'pd-standard' WHEN 1 THEN 'pd-ssd' ELSE 'pd-unknown' END"
        return f"(CASE WHEN o_orderkey % 4 > {i} THEN ((o_orderkey + {i}) % 50 * 10) * {disk_price(t, ssd)} ELSE 0 END)"

    days = f"CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {age('o_orderdate')} END"
    k = kept("o_orderkey")
    return f"""SELECT 'stopped-vm-with-disks', 'zone-' || (o_custkey % 3) || '/instances/vm-' || o_orderkey,
  CASE WHEN {k} THEN 'low' ELSE 'medium' END, {r(f'(({disk(0)} + {disk(1)}) + {disk(2)})')},
  CASE WHEN {k} THEN {quote(fixed.EXCLUDED)} ELSE {say(fixed.STOPPED_TEXT, days=days)} END, {k},
  '{{"machine_type":"n2-standard-' || (o_custkey % 8) || '","stopped_days":' || {days} || ',"excluded":' || {b(k)} || '}}'
FROM orders WHERE o_orderstatus = 'F' AND {days} >= {min_days}"""


def snapshots(min_age: int = 90) -> str:
    size = "((c_custkey * 37 % 5000) * 268435456)"
    days = age(f"{NOW} - to_days(CAST(c_custkey % 400 AS INTEGER)) - INTERVAL 2 HOUR")
    monthly = f"(CAST({size} AS DOUBLE) / 1073741824.0::DOUBLE * 0.032::DOUBLE)"
    k = kept("c_custkey")
    return f"""SELECT 'old-snapshot', 'snapshots/snap-' || c_custkey, CASE WHEN {monthly} > 10 AND NOT {k} THEN 'medium' ELSE 'low' END,
  {r(monthly)}, CASE WHEN {k} THEN {quote(fixed.EXCLUDED_SNAPSHOT)}
    ELSE {say(fixed.SNAPSHOT_TEXT, days=days, size=fbytes(size))} END, {k},
  '{{"age_days":' || {days} || ',"source_disk":"disk-' || (c_custkey % 100) || '","excluded":' || {b(k)} || '}}'
FROM customer WHERE {days} >= {min_age}"""


MACHINE = pick("c_custkey % 4", ["e2-standard-4", "n2-highmem-16", "custom", "e2-medium"])
VCPUS = "(CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 16 ELSE 2 END)"


def node_pools() -> str:
    node = f"(({VCPUS} * 0.0242::DOUBLE + ({VCPUS} * 4) * 0.0032::DOUBLE) * 730::DOUBLE)"
    node = f"(CASE WHEN c_custkey % 6 = 0 THEN {node} * {1 - 0.65!r}::DOUBLE ELSE {node} END)"
    return f"""SELECT 'empty-node-pool', 'gke-' || c_nationkey || '/nodePools/pool-' || c_custkey, 'high', {r(f'{node} * (c_custkey % 5)')},
  {quote(fixed.POOL_TEXT)}, FALSE,
  '{{"node_count":' || (c_custkey % 5) || ',"machine_type":"' || {MACHINE} || '","autoscaling":{{"enabled":' || {b('c_custkey % 2 = 0')} || ',"min":0,"max":' || (c_custkey % 9) || '}}}}'
FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0"""


def rules() -> str:
    return f"""SELECT 'lb-no-backends', 'region-' || (s_nationkey % 5) || '/forwardingRules/fr-' || s_suppkey, 'medium', {r('0.03::DOUBLE * 730::DOUBLE')},
  {quote(fixed.LB_TEXT)}, FALSE,
  '{{"scheme":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'EXTERNAL' ELSE 'INTERNAL' END || '","target":"target-' || (s_suppkey % 13) || '"}}'
FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_suppkey % 5 <> 0"""


TIER = pick("c_custkey % 4", ["db-custom-4-16384", "db-custom-2-7680", "db-f1-micro", "db-custom-x-1024"])
TIER_MONTHLY = """((CASE c_custkey % 4 WHEN 0 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * 0.0475::DOUBLE
  + CASE c_custkey % 4 WHEN 0 THEN 16.0::DOUBLE ELSE 7.5::DOUBLE END * 0.008::DOUBLE) * 730::DOUBLE + (c_custkey % 500) * 0.204::DOUBLE)"""


def sql_instances(max_connections: int = 1) -> str:
    k = kept("c_custkey")
    return f"""SELECT 'unused-cloudsql', 'region-' || (c_nationkey % 4) || '/sql/sql-' || c_custkey, CASE WHEN {k} THEN 'low' ELSE 'high' END,
  {r(TIER_MONTHLY)}, CASE WHEN {k} THEN {quote(fixed.EXCLUDED)}
    ELSE {say(fixed.SQL_TEXT, connections='(c_custkey % 5)')} END, {k},
  '{{"tier":"' || {TIER} || '","cpu_avg_14d":' || CAST(CAST(c_custkey % 100 AS DOUBLE) / 100 AS VARCHAR) || ',"excluded":' || {b(k)} || '}}'
FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 4 <> 3 AND c_custkey % 5 <= {max_connections}"""


NAMES = "(category, resource, severity, monthly_cost_estimate, recommendation, excluded, details)"


def union(snapshot_age: int = 90, stopped: int = 14, connections: int = 1, ssd: float = 0.204) -> str:
    parts = [disks(ssd), addresses(), instances(stopped, ssd), snapshots(snapshot_age), node_pools(), rules(), sql_instances(connections)]
    return "\nUNION ALL\n".join(parts)


def cte(name: str, **kw) -> str:
    return f"{name}{NAMES} AS (\n{union(**kw)}\n)"


def single(sql: str) -> str:
    return f"WITH f{NAMES} AS ({sql}) SELECT * FROM f"


F_ALL = cte("f")
ORACLE: dict[str, str] = {
    "I0a_keep_label": f"SELECT 'disk-' || p_partkey AS name, {kept('p_partkey')} AS excluded FROM part",
    "I0b_disk_price": f"SELECT 'disk-' || p_partkey AS name, {DISK_TYPE} AS type, {disk_price(DISK_TYPE)} AS gb_month FROM part",
    "I0c_sql_tier_monthly": f"SELECT 'sql-' || c_custkey AS name, {TIER} AS tier, {r(TIER_MONTHLY)} AS monthly FROM customer",
    "I0d_machine_vcpus": f"SELECT 'pool-' || c_custkey AS name, {MACHINE} AS machine_type, {VCPUS} AS vcpus FROM customer",
    "I0e_age_days": f"SELECT 'vm-' || o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {age('o_orderdate')} END AS age_days FROM orders",
    "I1_unattached_disks": disks(),
    "I2_idle_addresses": single(addresses()),
    "I3_stopped_instances": single(instances()),
    "I4_old_snapshots": single(snapshots()),
    "I5_empty_node_pools": single(node_pools()),
    "I6_lbs_without_backends": single(rules()),
    "I7_unused_sql": single(sql_instances()),
    "I8_all_findings": f"WITH {F_ALL} SELECT * FROM f",
    "I9_sorted_findings": f"WITH {F_ALL} SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END AS severity_rank FROM f ORDER BY severity_rank, monthly_cost_estimate DESC, resource",
    "I10_actionable_split": f"WITH {F_ALL} SELECT CASE WHEN excluded THEN 'excluded' ELSE 'actionable' END AS part, category, resource, monthly_cost_estimate FROM f",
    "I11_category_rollup": f"WITH {F_ALL} SELECT category, COUNT(*) AS findings, CAST(SUM(CAST(monthly_cost_estimate AS DECIMAL(18,2))) AS DOUBLE) AS monthly_cost_estimate FROM f WHERE NOT excluded GROUP BY category",
    "I12_report_totals": f"""WITH {F_ALL} SELECT COUNT(*) FILTER (NOT excluded) AS actionable, COUNT(*) FILTER (excluded) AS excluded,
  CAST(SUM(CAST(monthly_cost_estimate AS DECIMAL(18,2))) FILTER (NOT excluded) AS DOUBLE) AS actionable_run_rate,
  CAST(SUM(CAST(monthly_cost_estimate AS DECIMAL(18,2))) AS DOUBLE) AS total_monthly_estimate FROM f""",
    "D6_findings_delta": f"""WITH {cte('a', snapshot_age=60, connections=0)}, {cte('b', stopped=400, ssd=0.3)}
SELECT COALESCE(a.category, b.category) AS category, COALESCE(a.resource, b.resource) AS resource,
  a.monthly_cost_estimate AS previous_cost, b.monthly_cost_estimate AS current_cost,
  {r('COALESCE(b.monthly_cost_estimate, 0) - COALESCE(a.monthly_cost_estimate, 0)')} AS cost_delta,
  CASE WHEN a.category IS NULL THEN 'new' WHEN b.category IS NULL THEN 'resolved'
    WHEN a.monthly_cost_estimate <> b.monthly_cost_estimate THEN 'changed' ELSE 'unchanged' END AS change
FROM a FULL OUTER JOIN b ON a.category = b.category AND a.resource = b.resource""",
}

CUTOFF = f"({NOW} - INTERVAL 30 DAY)"
# Exact match: 'True' is not the exclusion value.
EXACT = "({k} % 22 = 0)"


def plan_disks() -> str:
    k = EXACT.format(k="p_partkey")
    old = f"""CASE WHEN p_partkey % 5 < 2 THEN {NOW} - to_days(CAST(p_partkey % 200 AS INTEGER)) - INTERVAL 1 HOUR
      ELSE {NOW} - to_days(CAST(p_partkey % 80 AS INTEGER)) - INTERVAL 7 HOUR END < {CUTOFF}"""
    return f"""SELECT 'disk' AS kind, 'disk-' || p_partkey AS resource, 'zone-' || (p_partkey % 3) AS scope,
  CASE WHEN {k} THEN 'SKIP' ELSE 'PLAN' END AS decision, s.step,
  CASE s.step WHEN 0 THEN 'skip' WHEN 1 THEN 'snapshot pre-delete-disk-' || p_partkey || '-20000624' ELSE 'delete' END AS action
FROM part, (VALUES (0), (1), (2)) s(step) WHERE p_partkey % 3 <> 0 AND {old} AND (s.step = 0) = {k}"""


def plan_snapshots() -> str:
    k = EXACT.format(k="c_custkey")
    old = f"{NOW} - to_days(CAST(c_custkey % 400 AS INTEGER)) - INTERVAL 2 HOUR < {CUTOFF}"
    return f"""SELECT 'snapshot' AS kind, 'snap-' || c_custkey AS resource, 'global' AS scope, CASE WHEN {k} THEN 'SKIP' ELSE 'PLAN' END AS decision,
  CASE WHEN {k} THEN 0 ELSE 1 END AS step, CASE WHEN {k} THEN 'skip' ELSE 'delete' END AS action
FROM customer WHERE {old} AND c_custkey % 7 <> 0"""


def plan_addresses() -> str:
    k = EXACT.format(k="s_suppkey")
    old = f"{NOW} - to_days(CAST(s_suppkey % 100 AS INTEGER)) - INTERVAL 3 HOUR < {CUTOFF}"
    return f"""SELECT 'address' AS kind, 'addr-' || s_suppkey AS resource, CASE WHEN s_suppkey % 6 = 0 THEN 'global' ELSE 'region-' || (s_nationkey % 5) END AS scope,
  CASE WHEN {k} THEN 'SKIP' ELSE 'PLAN' END AS decision, CASE WHEN {k} THEN 0 ELSE 1 END AS step, CASE WHEN {k} THEN 'skip' ELSE 'delete' END AS action
FROM supplier WHERE {old} AND s_suppkey % 3 <> 0"""


ORACLE["C1_disk_plan"] = plan_disks()
ORACLE["C2_snapshot_plan"] = plan_snapshots()
ORACLE["C3_address_plan"] = plan_addresses()
ORACLE["C4_combined_plan"] = f"""SELECT kind, decision, COUNT(DISTINCT resource) AS resources
FROM ({plan_disks()} UNION ALL {plan_snapshots()} UNION ALL {plan_addresses()}) GROUP BY ALL"""

POOLS = """pools AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 4 = 0 THEN 'example-prod-' ELSE 'example-dev-' END || s_suppkey AS project,
  CASE WHEN s_suppkey % 7 = 0 THEN 'prod-gke' ELSE 'dev-gke' END AS cluster, 'region-' || s_nationkey AS location,
  'pool-' || (s_suppkey % 5) AS pool, CAST(s_suppkey % 4 AS INTEGER) AS day_count FROM supplier WHERE s_suppkey % 10 < 8)"""


def schedule(size: str) -> str:
    refused = "(s % 4 = 0 OR s % 7 = 0)"
    return f"""WITH {POOLS} SELECT project, cluster, location, pool, CASE WHEN {refused} THEN 'REFUSE' ELSE 'PLAN' END AS decision,
  CASE WHEN NOT {refused} THEN {size} END AS target_nodes, CASE WHEN NOT {refused} AND s % 3 = 1 THEN {size} END AS autoscale_min,
  CASE WHEN NOT {refused} AND s % 3 = 1 THEN {size} * 4 END AS autoscale_max FROM pools"""


ORACLE["C5_schedule_down"] = schedule("0")
ORACLE["C5_schedule_up"] = schedule("day_count")
ORACLE["SRC9_pool_config"] = f"WITH {POOLS} SELECT project, cluster, location, pool, day_count FROM pools"
ORACLE["SRC4_inventory_documents"] = f"""SELECT 'disk-' || p_partkey AS name, 'zone-' || (p_partkey % 3) AS zone, {DISK_TYPE} AS type, p_size * 10 AS size_gb,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n_users,
  CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'True' END END AS keep FROM part"""
ORACLE["SRC5_priced_disks"] = f"""SELECT replace({DISK_TYPE}, '-', '_') || '_gb_month' AS key,
  CASE p_partkey % 4 WHEN 0 THEN 0.048::DOUBLE WHEN 1 THEN 0.12::DOUBLE WHEN 2 THEN 0.204::DOUBLE END AS price,
  COUNT(*) AS disks, CAST(SUM(p_size * 10) AS BIGINT) AS size_gb FROM part GROUP BY ALL"""
ORACLE["SRC8_flatten_vpa"] = """SELECT 'ns-' || (p_partkey % 12) AS namespace, 'wl-' || p_partkey AS workload, 'c' || i.i AS container,
  CAST((p_partkey * 11 + i.i) % 800 AS INTEGER) AS target_cpu_m,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST((p_partkey * 5 + i.i) % 2000 AS INTEGER) END AS target_mem_mi
FROM part, (VALUES (0), (1)) i(i) WHERE p_partkey % 10 <> 0"""
