"""Oracle SQL of the rightsizing, warehouse, storage, cache and summary queries."""

from __future__ import annotations

from outlay import fixed
from outlay.oracle.billing import AS_OF, div, r
from outlay.oracle.inventory import F_ALL, NOW, fbytes, money, pick
from outlay.oracle.text import quote, say

ORACLE: dict[str, str] = {}


def pct(x: str, digits: int = 0) -> str:
    return f"format('{{:.{digits}f}}%', CAST({x} AS DOUBLE) * 100)"


# ------------------------------------------------------------------ rightsizing
USAGE = """usage AS (SELECT p_partkey AS pk, 'ns-' || (p_partkey // 50) AS namespace, 'wl-' || (p_partkey // 2) AS workload,
  CASE (p_partkey // 2) % 4 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'CronJob' WHEN 2 THEN 'DaemonSet' ELSE 'StatefulSet' END AS kind,
  'c' || (p_partkey % 2) AS container, CAST(p_partkey % 9 + 1 AS INTEGER) AS replicas, CAST(p_size * 20 AS INTEGER) AS cur_cpu,
  CAST((p_partkey % 40) * 64 AS INTEGER) AS cur_mem, CAST((p_partkey * 7) % 900 AS DOUBLE) AS p95,
  CAST((p_partkey * 7) % 900 + p_partkey % 50 AS DOUBLE) AS p99, CAST((p_partkey * 13) % 2500 AS DOUBLE) AS m99,
  CASE WHEN p_partkey % 6 <> 0 THEN CAST((p_partkey * 13) % 2500 + p_partkey % 64 AS DOUBLE) END AS mmax,
  CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 3 ELSE 0 END AS oom, CAST(p_partkey % 40 AS DOUBLE) / 100 AS thr FROM part)"""


def up(x: str, step: int) -> str:
    return f"CAST(CASE WHEN {x} > 0 THEN ceil({x} / {step}) * {step} ELSE {step} END AS INTEGER)"


def cost(cpu: str, mem: str) -> str:
    return f"(({cpu} / 1000.0::DOUBLE * 0.0242::DOUBLE + {mem} / 1024.0::DOUBLE * 0.0032::DOUBLE) * replicas * 730::DOUBLE)"


RECS = f"""{USAGE},
s1 AS (SELECT *, (oom > 0 OR thr > 0.25) AS unsafe FROM usage),
s2 AS (SELECT *, {up('((CASE WHEN unsafe THEN GREATEST(p99, p95) ELSE p95 END) * 1.3::DOUBLE)', 50)} AS rc,
  {up('((CASE WHEN unsafe THEN GREATEST(COALESCE(mmax, m99), m99) ELSE m99 END) * 1.2::DOUBLE)', 32)} AS rm FROM s1),
s3 AS (SELECT *, ABS(CASE WHEN cur_cpu = 0 THEN 1.0::DOUBLE ELSE CAST(rc - cur_cpu AS DOUBLE) / cur_cpu END) < 0.15
  AND ABS(CASE WHEN cur_mem = 0 THEN 1.0::DOUBLE ELSE CAST(rm - cur_mem AS DOUBLE) / cur_mem END) < 0.15 AS within,
  {up('GREATEST(p99 * 2, CAST(rc * 2 AS DOUBLE))', 50)} AS lim FROM s2),
s4 AS (SELECT *, CASE WHEN unsafe THEN 'under' WHEN within THEN 'ok' WHEN {cost('rc', 'rm')} < {cost('cur_cpu', 'cur_mem')} THEN 'over' ELSE 'under' END AS status FROM s3),
s5 AS (SELECT *, CASE WHEN status = 'ok' THEN cur_cpu ELSE rc END AS fc, CASE WHEN status = 'ok' THEN cur_mem ELSE rm END AS fm,
  NOT unsafe AND NOT within AND (rc > cur_cpu) <> (rm > cur_mem) AS mixed FROM s4),
recs AS (SELECT *, {r(cost('fc', 'fm') + ' - ' + cost('cur_cpu', 'cur_mem'))} AS delta,
  concat_ws(' | ', CASE WHEN oom > 0 THEN {say(fixed.NOTE_OOM, n='oom')} END,
    CASE WHEN thr > 0.25 THEN {say(fixed.NOTE_THROTTLED, pct=pct('thr'))} END,
    CASE WHEN status = 'ok' THEN {quote(fixed.NOTE_WITHIN)} END,
    CASE WHEN mixed THEN {quote(fixed.NOTE_MIXED)} END,
    CASE WHEN kind = 'CronJob' THEN {quote(fixed.NOTE_BATCH)} END,
    CASE WHEN kind = 'DaemonSet' THEN {quote(fixed.NOTE_DAEMON)} END) AS notes FROM s5)"""


def rec_select(limit: str) -> str:
    return f"""WITH {RECS} SELECT namespace, workload, kind, container, replicas, cur_cpu AS current_cpu_request_m, cur_mem AS current_mem_request_mi,
  p95 AS cpu_p95_m, p99 AS cpu_p99_m, m99 AS mem_p99_mi, fc AS rec_cpu_request_m, {limit} AS rec_cpu_limit_m, fm AS rec_mem_request_mi,
  fm AS rec_mem_limit_mi, status, delta AS monthly_delta_estimate, notes FROM recs"""


ORACLE["K1a_workload_of_pod"] = """SELECT DISTINCT 'svc' || (user_id % 10) || '-rs' || (user_id % 3) || '-p' || user_id AS pod,
  'svc' || (user_id % 10) AS workload FROM events"""
ORACLE["K2_recommendations"] = rec_select("CAST(NULL AS INTEGER)")
ORACLE["K2_recommendations_with_limits"] = rec_select("lim")
ORACLE["K2a_round_up"] = f"""WITH {USAGE} SELECT namespace, workload, container, {up('p95', 50)} AS cpu_step, {up('m99', 32)} AS mem_step FROM usage"""
ORACLE["K2b_request_deltas"] = f"""WITH {RECS} SELECT namespace, workload, container, (fc - cur_cpu) * replicas / 1000.0::DOUBLE AS cpu_delta_cores,
  (fm - cur_mem) * replicas / 1024.0::DOUBLE AS mem_delta_gib FROM recs"""
ORACLE["K3_vpa_comparison"] = f"""WITH {RECS},
j AS (SELECT *, CASE WHEN pk % 3 = 0 THEN NULL WHEN pk % 4 = 0 THEN 77 ELSE CAST((pk * 11) % 800 AS INTEGER) END AS vc,
  CASE WHEN pk % 3 = 0 THEN NULL WHEN pk % 4 = 0 THEN 177 ELSE CAST((pk * 5) % 2000 AS INTEGER) END AS vm FROM recs),
g AS (SELECT *, CAST(ABS(fc - vc) AS DOUBLE) / GREATEST(vc, 1) AS gap FROM j)
SELECT namespace, workload, container, fc AS rec_cpu_request_m, vc AS vpa_target_cpu_m, vm AS vpa_target_mem_mi,
  CASE WHEN gap > 0.5 THEN CASE WHEN notes = '' THEN '' ELSE notes || ' | ' END || {say(fixed.NOTE_VPA, pct=pct('gap'))} ELSE notes END AS notes
FROM g"""
ORACLE["K4_sorted_recommendations"] = f"""WITH {RECS} SELECT namespace, workload, container,
  CASE status WHEN 'under' THEN 0 WHEN 'over' THEN 1 ELSE 2 END AS status_rank, delta AS monthly_delta_estimate FROM recs ORDER BY 4, 5"""
K5 = f"""SELECT COUNT(*) AS containers, COUNT(*) FILTER (status = 'over') AS over, COUNT(*) FILTER (status = 'under') AS under, COUNT(*) FILTER (status = 'ok') AS ok,
  {r("COALESCE(SUM((cur_cpu - fc) * replicas) FILTER (fc < cur_cpu), 0) / 1000.0::DOUBLE")} AS releasable_cores,
  {r("COALESCE(SUM((cur_mem - fm) * replicas) FILTER (fm < cur_mem), 0) / 1024.0::DOUBLE")} AS releasable_gib,
  CAST(COALESCE(-SUM(CAST(delta AS DECIMAL(18,2))) FILTER (delta < 0), 0) AS DOUBLE) AS monthly_reduction,
  CAST(COALESCE(SUM(CAST(delta AS DECIMAL(18,2))) FILTER (delta > 0), 0) AS DOUBLE) AS monthly_increase FROM recs"""
ORACLE["K5_rightsizing_summary"] = f"WITH {RECS} {K5}"
ORACLE["K6_patch_documents"] = f"""WITH {RECS},
g AS (SELECT namespace, workload, MIN(kind) AS kind, '[' || string_agg('{{"name":"' || container || '","resources":{{"requests":{{"cpu":"' || fc || 'm","memory":"' || fm
  || 'Mi"}},"limits":{{"memory":"' || fm || 'Mi"}}}}}}', ',' ORDER BY container) || ']' AS cs FROM recs WHERE status <> 'ok' GROUP BY ALL)
SELECT namespace, workload, '{{"apiVersion":"' || CASE WHEN kind = 'CronJob' THEN 'batch/v1' ELSE 'apps/v1' END || '","kind":"' || kind || '","metadata":{{"name":"' || workload
  || '","namespace":"' || namespace || '"}},"spec":{{' || CASE WHEN kind = 'CronJob' THEN '"jobTemplate":{{"spec":{{"template":{{"spec":{{"containers":' || cs || '}}}}}}}}' ELSE '"template":{{"spec":{{"containers":' || cs || '}}}}' END || '}}}}' AS patch
FROM g"""
ORACLE["D8_quota_sizing"] = f"""WITH {RECS},
g AS (SELECT namespace, CAST(SUM(fc * replicas) AS BIGINT) AS recommended_cpu_m, CAST(SUM(fm * replicas) AS BIGINT) AS recommended_mem_mi FROM recs GROUP BY namespace),
s AS (SELECT *, CAST(ceil(recommended_cpu_m * 1.3::DECIMAL(4,2)) AS BIGINT) AS sized_cpu_m, CAST(ceil(recommended_mem_mi * 1.3::DECIMAL(4,2)) AS BIGINT) AS sized_mem_mi FROM g),
q AS (SELECT 'ns-' || ns AS namespace, CASE WHEN ns % 4 <> 3 THEN size * 160 END AS quota_cpu_m, CASE WHEN ns % 4 <> 3 THEN size * 400 END AS quota_mem_mi
  FROM (SELECT p_partkey // 50 AS ns, CAST(SUM(p_size) AS BIGINT) AS size FROM part GROUP BY ALL))
SELECT s.*, quota_cpu_m, quota_mem_mi, COALESCE(sized_cpu_m > quota_cpu_m OR sized_mem_mi > quota_mem_mi, FALSE) AS breach FROM s LEFT JOIN q USING (namespace)"""
ORACLE["D12_range_conformance"] = """WITH c AS (SELECT 'ns-' || (p_partkey // 50) AS namespace, 'wl-' || (p_partkey // 2) AS workload, 'c' || (p_partkey % 2) AS container,
  (p_partkey // 50) % 4 = 2 AS free,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 20 AS INTEGER) WHEN (p_partkey // 50) % 4 <> 2 THEN 100 END AS cpu,
  CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 40 * 64 AS INTEGER) WHEN (p_partkey // 50) % 4 <> 2 THEN 256 END AS mem,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 40 * 64 + p_partkey % 3 * 16 AS INTEGER) WHEN (p_partkey // 50) % 4 <> 2 THEN 512 END AS lim FROM part)
SELECT namespace, workload, container, cpu AS effective_cpu_m, mem AS effective_mem_mi, lim AS effective_limit_mem_mi,
  NOT free AND cpu < 10 AS cpu_below_min, NOT free AND cpu > 600 AS cpu_above_max, NOT free AND mem < 32 AS mem_below_min,
  NOT free AND lim > 1600 AS mem_above_max, NOT free AND mem > 0 AND lim > mem AS ratio_exceeded FROM c"""

# ------------------------------------------------------------------ warehouse
LOG = f"""log AS (SELECT doc_id, text, source || '@example.com' AS user_email, lang, n_chars, n_chars % 300 AS seconds,
  doc_id % 40 AS back, doc_id % 10 = 9 AS load FROM documents
  WHERE {NOW} - to_days(CAST(doc_id % 40 AS INTEGER)) - INTERVAL 1 HOUR >= {NOW} - INTERVAL 30 DAY AND doc_id % 10 <> 9 AND doc_id % 23 <> 22 AND doc_id % 17 <> 16),
rolled AS (SELECT md5(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g')) AS query_hash, lang AS label_team, COUNT(*) AS run_count,
  CAST(SUM(n_chars * 1000000000) AS BIGINT) AS total_bytes_billed, CAST(SUM(n_chars * 500000) AS BIGINT) AS total_slot_ms, {r('AVG(seconds)', 4)} AS avg_duration_s,
  arg_min(user_email, doc_id) AS user_email, arg_min(text, doc_id) AS sample_sql FROM log GROUP BY ALL)"""
ORACLE["Q1_query_rollup"] = f"WITH {LOG} SELECT * FROM rolled ORDER BY total_bytes_billed DESC, query_hash, label_team LIMIT 200"
ORACLE["SRC6_query_log_rollup"] = f"WITH {LOG} SELECT query_hash, label_team, run_count, total_bytes_billed, total_slot_ms, user_email FROM rolled"
JOBS = """jobs AS (SELECT doc_id, 'q' || doc_id AS query_hash, source || '@example.com' AS user_email, lang AS team, doc_id % 1500 + 1 AS runs,
  n_chars * 2000000000 AS bytes, n_chars * 9000000 AS slot_ms, doc_id % 150 AS t, CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_tables,
  CASE WHEN doc_id % 4 = 0 THEN 'select * from x where ' || text ELSE text END AS q FROM documents)"""
TIB = "1099511627776.0::DOUBLE"
ONDEMAND = f"(CAST(bytes AS DOUBLE) / {TIB} * 6.25::DOUBLE)"
ORACLE["Q2_on_demand_cost"] = f"WITH {JOBS} SELECT query_hash, {r(ONDEMAND, 4)} AS on_demand_cost FROM jobs"
PER_RUN = f"(CAST(bytes AS DOUBLE) / runs / {TIB})"
HINTS = f"""concat_ws('; ', CASE WHEN contains(upper(q), 'SELECT *') THEN {quote(fixed.HINT_STAR)} END,
  CASE WHEN runs >= 720 THEN {say(fixed.HINT_RUNS, n="format('{:.0f}', runs / 30.0::DOUBLE)")} END,
  CASE WHEN {PER_RUN} > 1 THEN {say(fixed.HINT_SCAN, n="format('{:.1f}', " + PER_RUN + ")")} END)"""
EXPENSIVE = f"""SELECT 'expensive-query' AS category, query_hash AS resource, CASE WHEN {ONDEMAND} * 30.0::DOUBLE / 30 > 500 THEN 'high' WHEN {ONDEMAND} * 30.0::DOUBLE / 30 > 50 THEN 'medium' ELSE 'low' END AS severity,
  {r(ONDEMAND + ' * 30.0::DOUBLE / 30')} AS monthly_cost_estimate, CASE WHEN {HINTS} = '' THEN {quote(fixed.HINT_NONE)} ELSE {HINTS} END AS recommendation, FALSE AS excluded,
  '{{"user":"' || user_email || '","team":"' || team || '","runs":' || runs || ',"bytes_billed":' || bytes || ',"tables":['
    || CASE n_tables WHEN 0 THEN '' WHEN 1 THEN '"ds.t' || t || '"' ELSE '"ds.t' || t || '","ds.t' || (t + 1) || '"' END || ']}}' AS details
FROM (SELECT * FROM jobs ORDER BY bytes DESC, query_hash LIMIT 5)"""
ORACLE["Q3_expensive_queries"] = f"WITH {JOBS} {EXPENSIVE}"
SCAN = """scan AS (SELECT tbl, CAST(SUM(share) AS DOUBLE) AS scan_bytes FROM (
  SELECT 'ds.t' || t AS tbl, CAST(CAST(bytes AS DOUBLE) / n_tables AS DECIMAL(38,6)) AS share FROM jobs WHERE n_tables > 0
  UNION ALL SELECT 'ds.t' || (t + 1), CAST(CAST(bytes AS DOUBLE) / n_tables AS DECIMAL(38,6)) FROM jobs WHERE n_tables = 2) GROUP BY tbl)"""
ORACLE["Q4_scan_attribution"] = f'WITH {JOBS}, {SCAN} SELECT tbl AS "table", scan_bytes FROM scan'
TABLES = """tables AS (SELECT p_partkey AS k, 'ds' || (p_partkey % 6) AS dataset, 'ds.t' || p_partkey AS tbl,
  CASE WHEN p_partkey % 13 = 0 THEN 5000000000 ELSE CAST(p_size AS BIGINT) * 400000000000 END AS total,
  CAST(p_size AS BIGINT) * 300000000000 AS active, CAST(p_size AS BIGINT) * 100000000000 AS lt,
  (CAST(p_size AS BIGINT) * 400000000000) // (p_partkey % 5 + 1) AS physical, p_partkey % 3 = 0 AS part, p_partkey % 4 = 0 AS clus,
  p_partkey % 9 = 0 AS expires, p_partkey % 120 AS ago, p_partkey % 6 = 0 AS guarded,
  CASE p_partkey % 5 WHEN 0 THEN 'customer_id, event_date, region' WHEN 1 THEN 'tenant_id, region' WHEN 2 THEN 'candidate_id' ELSE '' END AS cols,
  CASE p_partkey % 5 WHEN 0 THEN 'event_date' WHEN 2 THEN 'candidate_id' END AS date_col,
  CASE p_partkey % 5 WHEN 0 THEN '"customer_id","region"' ELSE '' END AS rest FROM part)"""
LAYOUT = f"""SELECT CASE WHEN branch = 1 THEN 'unpartitioned-table' ELSE 'unclustered-table' END AS category, tbl AS resource,
  CASE WHEN branch = 1 AND monthly > 500 THEN 'high' WHEN branch = 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN branch = 1 THEN {r('monthly * 0.8::DOUBLE')} ELSE {r('monthly * 0.3::DOUBLE')} END AS monthly_cost_estimate,
  CASE branch WHEN 1 THEN {say(fixed.PARTITION_TEXT, column='date_col')}
    WHEN 2 THEN {say(fixed.CLUSTER_ONLY_TEXT, columns='cols')}
    ELSE {say(fixed.CLUSTER_TEXT, columns='cols')} END AS recommendation, FALSE AS excluded,
  CASE branch WHEN 1 THEN '{{"size":"' || {fbytes('total')} || '","scanned_in_window":"' || {fbytes('scan_bytes')} || '","partition_column":"' || date_col || '","cluster_columns":[' || rest || ']}}'
    WHEN 2 THEN '{{"size":"' || {fbytes('total')} || '","scanned_in_window":"' || {fbytes('scan_bytes')} || '"}}'
    ELSE '{{"scanned_in_window":"' || {fbytes('scan_bytes')} || '"}}' END AS details
FROM (SELECT *, scan_bytes / {TIB} * 6.25::DOUBLE * 30.0::DOUBLE / 30 AS monthly,
    CASE WHEN NOT part AND date_col IS NOT NULL THEN 1 WHEN NOT part AND cols <> '' AND scan_bytes > 0 THEN 2 WHEN NOT clus AND scan_bytes > {TIB} THEN 3 END AS branch
  FROM (SELECT tables.*, COALESCE(scan.scan_bytes, 0) AS scan_bytes FROM tables LEFT JOIN scan USING (tbl) WHERE total >= 10000000000))
WHERE branch IS NOT NULL"""
ORACLE["Q5_table_layout"] = f"WITH {JOBS}, {SCAN}, {TABLES} {LAYOUT}"
ORACLE["Q5a_temporal_columns"] = f"""WITH {TABLES} SELECT tbl AS "table", date_col AS date_column,
  CASE k % 5 WHEN 0 THEN 'customer_id,region' WHEN 1 THEN 'tenant_id,region' ELSE '' END AS other_columns FROM tables"""
EXPIRATION = f"""SELECT 'partition-expiration' AS category, tbl AS resource, CASE WHEN ago >= 60 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN ago >= 60 THEN {r('active / 1e9::DOUBLE * 0.023::DOUBLE')} ELSE {r('lt / 1e9::DOUBLE * 0.016::DOUBLE * 0.5::DOUBLE')} END AS monthly_cost_estimate,
  CASE WHEN ago >= 60 THEN {say(fixed.STALE_TEXT, days='ago')}
    ELSE {say(fixed.RETENTION_TEXT, pct=pct('CAST(lt AS DOUBLE) / total'))} END AS recommendation,
  FALSE AS excluded, '{{"size":"' || {fbytes('total')} || '"}}' AS details
FROM tables WHERE part AND NOT expires AND (ago >= 60 OR total > 10995116277760)"""
ORACLE["Q6_partition_expiration"] = f"WITH {TABLES} {EXPIRATION}"
LONG_TERM = f"""SELECT 'long-term-storage' AS category, tbl AS resource, 'low' AS severity,
  {r(f'active / 1e9::DOUBLE * 0.7::DOUBLE * {0.023 - 0.016!r}::DOUBLE')} AS monthly_cost_estimate,
  {quote(fixed.LONG_TERM_TEXT)} AS recommendation,
  FALSE AS excluded, '{{"active":"' || {fbytes('active')} || '"}}' AS details FROM tables WHERE NOT part AND active / 1e9::DOUBLE > 1000 AND ago <= 7"""
ORACLE["Q7_long_term_storage"] = f"WITH {TABLES} {LONG_TERM}"
BREAKEVEN = f"""t AS (SELECT CAST(SUM(slot_ms) AS DOUBLE) / 3600000.0::DOUBLE AS hours, CAST(SUM(bytes) AS DOUBLE) / {TIB} * 6.25::DOUBLE * 1.0::DOUBLE AS od FROM jobs),
bl AS (SELECT *, hours / 720.0::DOUBLE AS avg_slots, GREATEST(100, CAST(round_even(hours / 720.0::DOUBLE / 100.0::DOUBLE + 0.5::DOUBLE, 0) * 100 AS BIGINT)) AS n FROM t),
be AS (SELECT *, n * 0.048::DOUBLE * 730::DOUBLE AS std, n * 0.072::DOUBLE * 730::DOUBLE AS ent, n * 0.058::DOUBLE * 730::DOUBLE AS e1 FROM bl),
breakeven AS (SELECT 30 AS window_days, {r('hours', 1)} AS total_slot_hours, {r('avg_slots', 1)} AS avg_slots_needed, {r('od')} AS on_demand_monthly, {r('std')} AS slots_standard_monthly,
  {r('ent')} AS slots_enterprise_monthly, {r('e1')} AS slots_enterprise_1y_monthly,
  CASE WHEN od > LEAST(std, e1) * 1.2::DOUBLE THEN {say(fixed.SLOTS_MOVE, n='n', pct=pct('od / LEAST(std, e1) - 1'))}
    WHEN od < LEAST(std, e1) * 0.8::DOUBLE THEN {quote(fixed.SLOTS_STAY)}
    ELSE {quote(fixed.SLOTS_NEAR)} END AS recommendation FROM be)"""
ORACLE["Q8_slot_breakeven"] = f"WITH {JOBS}, {BREAKEVEN} SELECT * FROM breakeven"
ORACLE["Q9_suggested_ddl"] = f"""WITH {JOBS}, {SCAN}, {TABLES}
SELECT category, resource, {say(fixed.DDL_HEAD, table='resource', column='date_col')} || CASE WHEN rest = '' THEN '' ELSE {say(fixed.DDL_CLUSTER, columns="replace(replace(rest, '" + '"' + "', ''), ',', ', ')")} END
  || {say(fixed.DDL_TAIL, table='resource')} AS ddl
FROM ({LAYOUT}) l JOIN tables ON tbl = resource WHERE category = 'unpartitioned-table'
UNION ALL SELECT category, resource, {say(fixed.DDL_EXPIRE, table='resource')} FROM ({EXPIRATION})"""
ORACLE["Q10_top_users"] = f"""SELECT source || '@example.com' AS user_email, COUNT(*) AS runs, {r(f'CAST(SUM(n_chars * 1000000000) AS DOUBLE) / {TIB}')} AS tib FROM documents
  WHERE {NOW} - to_days(CAST(doc_id % 40 AS INTEGER)) - INTERVAL 1 HOUR > {NOW} - INTERVAL 30 DAY AND doc_id % 10 <> 9 GROUP BY source
  ORDER BY SUM(n_chars) DESC, 1 LIMIT 20"""
ORACLE["Q11_unguarded_tables"] = f'WITH {TABLES} SELECT tbl AS "table", total AS total_logical_bytes, part AS partitioned FROM tables WHERE total > 1000000000000 AND NOT guarded'
ORACLE["Q12_storage_billing"] = f"""WITH {TABLES}, s AS (SELECT dataset, CAST(SUM(active) AS DOUBLE) / 1e9 * 0.023::DOUBLE + CAST(SUM(lt) AS DOUBLE) / 1e9 * 0.016::DOUBLE AS logical,
  CAST(SUM(physical) AS DOUBLE) / 1e9 * 0.046::DOUBLE AS physical FROM tables GROUP BY dataset)
SELECT dataset, {r('logical')} AS logical_monthly, {r('physical')} AS physical_monthly, {r('LEAST(logical, physical)')} AS best_monthly,
  CASE WHEN physical < logical THEN 'PHYSICAL' ELSE 'LOGICAL' END AS best_model FROM s"""

# ------------------------------------------------------------------ storage
C4 = ["STANDARD", "NEARLINE", "COLDLINE", "ARCHIVE"]
BUCKETS = f"""buckets AS (SELECT c_custkey AS k, 'bucket-' || c_custkey AS bucket, CASE WHEN c_custkey % 5 < 2 THEN 0 ELSE c_custkey % 4 END AS cur,
  c_custkey % 2 = 0 AS versioned, c_custkey % 6 = 0 AS has_rules, c_custkey % 3 <> 0 AS unlabelled,
  CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 1000 END AS a_ops, CASE WHEN c_custkey % 8 = 0 THEN 20000000 ELSE c_custkey * 100 END AS b_ops,
  CASE WHEN c_custkey % 9 = 0 THEN 0.0::DOUBLE ELSE CAST(c_custkey % 120 * 10 AS DOUBLE) END AS read_gb,
  CASE WHEN c_custkey % 10 = 0 THEN 999 ELSE c_custkey % 90 END AS read_age,
  c_custkey * 1000000000 AS b0, (c_custkey % 100) * 7000000000 AS b1, (c_custkey % 50) * 11000000000 AS b2, (c_custkey % 30) * 13000000000 AS b3,
  CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 20 * 3000000000 END AS nc FROM customer),
heated AS (SELECT *, CASE WHEN b_ops > 10000000 OR read_gb > 1000 THEN 0 WHEN read_age <= 30 THEN 1 ELSE 2 END AS heat FROM buckets),
-- target class of bands 1, 2 and 3 as an index into the class list; band 0 stays standard
targets AS (SELECT *, 0 AS t0, CASE heat WHEN 2 THEN 1 ELSE 0 END AS t1, CASE heat WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS t2,
  CASE heat WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS t3, b0 + b1 + b2 + b3 AS live FROM heated),
classes AS (SELECT *, GREATEST(t0, cur) AS c0, GREATEST(t1, cur) AS c1, GREATEST(t2, cur) AS c2, GREATEST(t3, cur) AS c3 FROM targets)"""
PRICES = ["0.023::DOUBLE", "0.013::DOUBLE", "0.006::DOUBLE", "0.0025::DOUBLE"]
RETRIEVAL = [None, "0.01::DOUBLE", "0.02::DOUBLE", "0.05::DOUBLE"]
CUR_PRICE = "(CASE cur " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PRICES)) + " END)"
OPS = "(a_ops / 10000.0::DOUBLE * 0.05::DOUBLE + b_ops / 10000.0::DOUBLE * 0.004::DOUBLE)"


def in_class(i: int) -> str:
    return "(" + " + ".join(f"CASE WHEN c{j} = {i} THEN b{j} ELSE 0 END" for j in range(4)) + ")"


_STORE = " + ".join(f"p{i} / 1e9::DOUBLE * {p}" for i, p in enumerate(PRICES))
_RETR = " + ".join(f"read_gb * ((p1 + p2 + p3) / GREATEST(live, 1)::DOUBLE) * (p{i} / GREATEST(live, 1)::DOUBLE) * {RETRIEVAL[i]}" for i in (1, 2, 3))


def rule_sql(i: int) -> str:
    used = f"(c0 = {i} OR c1 = {i} OR c2 = {i} OR c3 = {i}) AND cur <> {i}"
    start = f"CASE WHEN t1 = {i} THEN 30 WHEN t2 = {i} THEN 90 WHEN t3 = {i} THEN 365 END"
    frm = "CASE cur " + " ".join(f"WHEN {c} THEN '{','.join(chr(34) + x + chr(34) for x in C4[c:i])}'" for c in range(i)) + " END"
    return f"""CASE WHEN {used} THEN '{{"action":{{"type":"SetStorageClass","storageClass":"{C4[i]}"}},"condition":{{"age":' || {start} || ',"matchesStorageClass":[' || {frm} || ']}}}}' END"""


OLD = "versioned AND nc > 0"
PLANS = f"""{BUCKETS},
shares AS (SELECT *, {', '.join(f'{in_class(i)} AS p{i}' for i in range(4))} FROM classes),
costs AS (SELECT *, {_RETR} AS retrieval, (live + nc) / 1e9::DOUBLE * {CUR_PRICE} + {OPS} AS cur_cost FROM shares),
rounded AS (SELECT *, {r('cur_cost')} AS current_monthly,
  {r(f'GREATEST(0, {_STORE} + {OPS} + retrieval + CASE WHEN {OLD} THEN nc * 0.2::DOUBLE ELSE nc END / 1e9::DOUBLE * {CUR_PRICE})')} AS proposed_monthly FROM costs),
plans AS (SELECT *, {r('current_monthly - proposed_monthly')} AS saving,
  {' + '.join(f"CASE WHEN (c0 = {i} OR c1 = {i} OR c2 = {i} OR c3 = {i}) AND cur <> {i} THEN 1 ELSE 0 END" for i in (1, 2, 3))} + CASE WHEN {OLD} THEN 2 ELSE 0 END AS n_rules,
  '[' || concat_ws(',', {', '.join(rule_sql(i) for i in (1, 2, 3))},
    CASE WHEN {OLD} THEN '{{"action":{{"type":"Delete"}},"condition":{{"isLive":false,"daysSinceNoncurrentTime":30}}}}' END,
    CASE WHEN {OLD} THEN '{{"action":{{"type":"Delete"}},"condition":{{"isLive":false,"numNewerVersions":3}}}}' END) || ']' AS rules_text,
  [n FOR n IN [CASE WHEN has_rules THEN {say(fixed.NOTE_RULES, n=quote('1'))} END,
    CASE WHEN {OLD} THEN {say(fixed.NOTE_VERSIONS, size=fbytes('nc'), days=quote('30'), keep=quote('3'))} END,
    CASE WHEN retrieval > 0 THEN {say(fixed.NOTE_RETRIEVAL, cost=money('retrieval'), gb='CAST(read_gb AS VARCHAR)')} END,
    CASE WHEN heat = 0 THEN {quote(fixed.NOTE_HOT)} END,
    CASE WHEN unlabelled THEN {quote(fixed.NOTE_UNLABELLED)} END] IF n IS NOT NULL] AS note_list FROM rounded)"""
ORACLE["G1_band_class_plan"] = f"""WITH {BUCKETS}, b AS (SELECT bucket, UNNEST([{{'band': '0-30', 'c': t0}}, {{'band': '30-90', 'c': t1}}, {{'band': '90-365', 'c': t2}}, {{'band': '365+', 'c': t3}}]) AS e FROM targets)
SELECT bucket AS name, e.band AS band, {pick('e.c', C4)} AS class FROM b"""
ORACLE["G2_storage_cost"] = f"""WITH {BUCKETS}, s AS (SELECT cur, CAST(SUM(b0 + b1 + b2 + b3 + nc) AS DOUBLE) AS bytes, SUM(a_ops) AS a_ops, SUM(b_ops) AS b_ops FROM buckets GROUP BY cur)
SELECT {pick('cur', C4)} AS class, bytes, {r(f'bytes / 1e9::DOUBLE * {CUR_PRICE}')} AS storage_monthly, {r(OPS)} AS ops_monthly FROM s"""
ORACLE["G3_bucket_plans"] = f"""WITH {PLANS} SELECT bucket, {pick('cur', C4)} AS current_class, CAST(live + nc AS BIGINT) AS total_bytes, current_monthly, proposed_monthly, saving,
  CAST(n_rules AS INTEGER) AS rules, array_to_string(note_list, ' | ') AS notes FROM plans"""
ORACLE["G3a_lifecycle_rules"] = f"""WITH {PLANS} SELECT bucket, '{{"lifecycle":{{"rule":' || rules_text || '}}}}' AS lifecycle FROM plans WHERE n_rules > 0"""
ORACLE["G4_bucket_findings"] = f"""WITH {PLANS} SELECT 'gcs-lifecycle' AS category, bucket AS resource, CASE WHEN saving > 100 THEN 'high' WHEN saving > 10 THEN 'medium' ELSE 'low' END AS severity,
  saving AS monthly_cost_estimate, CASE WHEN n_rules > 0 THEN {say(fixed.RULES_TEXT, n='n_rules')} ELSE {quote(fixed.RULES_NONE)} END AS recommendation, FALSE AS excluded,
  '{{"rules":' || rules_text || ',"notes":[' || array_to_string(['"' || n || '"' FOR n IN note_list], ',') || ']}}' AS details FROM plans"""
ORACLE["G5_total_saving"] = f"WITH {PLANS} SELECT COUNT(*) AS buckets, CAST(SUM(CAST(saving AS DECIMAL(18,2))) AS DOUBLE) AS monthly_saving FROM plans"
AGE = f"({AS_OF} - CAST(l_shipdate AS DATE))"
SIZE = "CAST(l_quantity AS BIGINT) * 1000000"
ORACLE["G6_age_bands"] = f"""SELECT 'bucket-' || l_suppkey AS bucket, CAST(COALESCE(SUM({SIZE}) FILTER ({AGE} < 30), 0) AS BIGINT) AS bytes_0_30,
  CAST(COALESCE(SUM({SIZE}) FILTER ({AGE} >= 30 AND {AGE} < 90), 0) AS BIGINT) AS bytes_30_90, CAST(COALESCE(SUM({SIZE}) FILTER ({AGE} >= 90 AND {AGE} < 365), 0) AS BIGINT) AS bytes_90_365,
  CAST(COALESCE(SUM({SIZE}) FILTER ({AGE} >= 365), 0) AS BIGINT) AS bytes_365_up FROM lineitem WHERE CAST(l_shipdate AS DATE) <= {AS_OF} GROUP BY l_suppkey"""
ORACLE["G7_unit_prices"] = f"""SELECT class, bytes, {pick('i', ['x', 'x', 'x', 'x']).replace("'x'", '{}').format(*PRICES)} AS storage_gb_month,
  CASE i WHEN 1 THEN 0.01::DOUBLE WHEN 2 THEN 0.02::DOUBLE WHEN 3 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS retrieval_per_gb, CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE 365 END AS INTEGER) AS min_days
FROM (SELECT l_partkey % 4 AS i, {pick('l_partkey % 4', C4)} AS class, CAST(SUM({SIZE}) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL)"""
ORACLE["D10_class_mix"] = f"""WITH m AS (SELECT {pick('l_partkey % 4', C4)} AS storage_class, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(SUM({SIZE}) AS BIGINT) AS bytes
  FROM lineitem WHERE CAST(l_shipdate AS DATE) <= {AS_OF} GROUP BY ALL)
SELECT storage_class, month, bytes, LAG(bytes) OVER w AS bytes_before, bytes - LAG(bytes) OVER w AS change FROM m WINDOW w AS (PARTITION BY storage_class ORDER BY month)"""

# ------------------------------------------------------------------ cache
SAMPLES = """samples AS (SELECT user_id AS u, CAST(ts AS DATE) AS date, CAST(SUM(CAST(floor(value * 100) AS BIGINT)) * 1000000 AS BIGINT) AS used,
  CAST(SUM(CAST(floor(value * 120) AS BIGINT)) * 1000000 AS BIGINT) AS rss, CAST(SUM(event_id % 100) AS BIGINT) AS hits, CAST(SUM(event_id % 17) AS BIGINT) AS misses,
  CAST(SUM(event_id % 5) AS BIGINT) AS evicted, CAST(SUM(event_id % 9) AS BIGINT) AS expired FROM events GROUP BY ALL)"""
GIB = "1073741824.0::DOUBLE"
GROWTH = f"""{SAMPLES},
numbered AS (SELECT *, used / {GIB} AS gib, CAST(row_number() OVER (PARTITION BY u ORDER BY date) - 1 AS DOUBLE) AS x FROM samples),
growth AS (SELECT u, COUNT(*) AS n, CAST(GREATEST(1, MAX(date) - MIN(date)) AS INTEGER) AS span_days, arg_max(gib, date) AS cur, arg_max(hits, date) AS hits, arg_max(misses, date) AS misses,
  arg_max(evicted, date) AS evicted, CASE WHEN COUNT(*) > 1 THEN COALESCE(regr_slope(gib, x), 0) * (COUNT(*) - 1) / GREATEST(1, MAX(date) - MIN(date)) ELSE 0 END AS g FROM numbered GROUP BY u)"""
LADDER = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160, 192, 256, 300]


def ladder(x: str) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {s} >= {x} THEN {s}" for s in LADDER) + f" ELSE ceil({x} / 50.0::DOUBLE) * 50 END AS INTEGER)"


STD = "(u % 3 <> 0)"


def rate(gb: str) -> str:
    return f"(CASE WHEN NOT {STD} THEN 0.026::DOUBLE WHEN {gb} > 100 THEN 0.03::DOUBLE WHEN {gb} > 35 THEN 0.035::DOUBLE ELSE 0.043::DOUBLE END)"


TTL = "(CAST(u % 101 AS DOUBLE) / 100)"
POLICY = f"CASE WHEN {TTL} >= 0.9 THEN 'volatile-lru' WHEN {STD} OR {TTL} > 0.5 THEN 'allkeys-lru' ELSE 'allkeys-lfu' END"
OPSP = "CAST(u * 700 % 200000 AS DOUBLE)"
BY_OPS = f"CAST(CASE WHEN {OPSP} = 0 THEN 1 ELSE ceil({OPSP} / 25000.0::DOUBLE) END AS INTEGER)"
CACHE = f"""{GROWTH},
c1 AS (SELECT *, (u % 150 + 1) * 858993459 / {GIB} AS maxmem, CAST(u % 150 + 1 AS DOUBLE) AS prov, cur + g * 90 AS projected, COALESCE({div('hits', 'hits + misses')}, 1.0::DOUBLE) AS hr FROM growth),
c2 AS (SELECT *, projected * 1.25::DOUBLE AS need, CASE WHEN g > 0 AND cur < maxmem THEN (maxmem - cur) / g END AS days FROM c1),
c3 AS (SELECT *, {ladder('need')} AS rec, CAST(ceil(need / 13.0::DOUBLE) AS INTEGER) AS smem, {BY_OPS} AS sops FROM c2),
c4 AS (SELECT *, GREATEST(1, smem, sops) AS shards FROM c3),
c5 AS (SELECT *, [a FOR a IN [
  CASE WHEN days < 60 THEN {say(fixed.ACTION_GROWTH, rate="format('{:.0f}', g * 1024)", days="format('{:.0f}', days)")} END,
  CASE WHEN u % 2 = 0 AND {TTL} < 0.9 THEN {say(fixed.ACTION_NOEVICTION, pct=pct(f'(1 - {TTL})'))} END,
  CASE WHEN hr < 0.8 THEN {say(fixed.ACTION_HITS, pct=pct('hr', 1))} END,
  CASE WHEN u % 4 <> 0 AND u % 2 <> 0 AND u * 1000 * 1048576 / {GIB} > 0.05 THEN {say(fixed.ACTION_KEYS, pattern="'sess:' || u", size="format('{:.2f}', u * 1000 * 1048576 / " + GIB + ")")} END,
  CASE WHEN u % 4 <> 0 AND u % 9 = 0 THEN {say(fixed.ACTION_KEYS, pattern=quote('board'), size=quote('0.37'))} END,
  CASE WHEN u % 4 <> 0 THEN {say(fixed.ACTION_KEYS, pattern=quote('feed'), size=quote('0.19'))} END,
  CASE WHEN u % 4 <> 0 AND u % 9 = 0 THEN {quote(fixed.ACTION_BIG_KEY)} END,
  CASE WHEN shards > 1 THEN {say(fixed.ACTION_SHARDS, n='shards', memory='smem', ops='sops')} END
  ] IF a IS NOT NULL] AS actions FROM c4)"""
ORACLE["R1_growth"] = f"WITH {GROWTH} SELECT 'cache-' || u AS instance, n, span_days, {r('g', 6)} AS growth_per_day, {r('cur', 6)} AS current_gib FROM growth"
ORACLE["R2_capacity_plan"] = f"""WITH {CACHE} SELECT 'cache-' || u AS instance, 'memorystore' AS provider, CASE WHEN u % 3 = 0 THEN 'BASIC' ELSE 'standard_ha' END AS tier, prov AS provisioned_gb,
  {r('maxmem')} AS maxmemory_gb, {r('cur')} AS current_used_gb, {r('cur / maxmem', 3)} AS utilisation, {r('g', 4)} AS growth_gb_per_day, {r('days', 1)} AS days_to_maxmemory,
  {r('projected')} AS projected_90d_gb, {r('hr', 4)} AS hit_ratio, evicted AS evictions_total, {TTL} AS ttl_coverage, rec AS recommended_gb, {POLICY} AS recommended_policy,
  {r('rec * 0.8::DOUBLE', 1)} AS recommended_maxmemory_gb, shards AS recommended_shards, {r(f"prov * {rate('prov')} * 730::DOUBLE")} AS current_monthly_estimate,
  {r(f"rec * {rate('rec')} * 730::DOUBLE")} AS recommended_monthly_estimate, CAST(len(actions) AS INTEGER) AS actions FROM c5"""
ORACLE["R2a_size_step"] = f"WITH {SAMPLES} SELECT 'cache-' || u AS instance, date, {ladder(f'(used / {GIB} * 1.25::DOUBLE)')} AS size_gb FROM samples"
ORACLE["R3_actions"] = f"""WITH {CACHE}, e AS (SELECT u, UNNEST(actions) AS action, UNNEST(range(len(actions))) AS p FROM c5)
SELECT 'cache-' || u AS instance, CAST(p AS INTEGER) AS position, action FROM e"""
CONFIG = "config AS (SELECT DISTINCT user_id AS u FROM events)"
ORACLE["R4_eviction_policy"] = f"WITH {CONFIG} SELECT 'cache-' || u AS instance, {POLICY} AS policy FROM config"
ORACLE["R5_shards"] = f"""WITH {CONFIG}, s AS (SELECT u, CAST(ceil((u % 150 + 1) * 1.25::DOUBLE / 13.0::DOUBLE) AS INTEGER) AS m, {BY_OPS} AS o FROM config)
SELECT 'cache-' || u AS instance, GREATEST(1, m, o) AS shards, m AS by_memory, o AS by_ops FROM s"""
ORACLE["R6_gb_hour_rate"] = f"""WITH {CONFIG}, s AS (SELECT u, CAST(u % 150 + 1 AS DOUBLE) AS gb FROM config)
SELECT 'cache-' || u AS instance, {rate('gb')} AS rate, {r(f"gb * {rate('gb')} * 730::DOUBLE")} AS monthly FROM s"""
ORACLE["R7_memory_trend"] = f"WITH {SAMPLES} SELECT 'cache-' || u AS instance, date, {r(f'used / {GIB}')} AS used_gib, {r(div('hits', 'hits + misses'), 3)} AS hit_ratio FROM samples"
ORACLE["D11_fragmentation"] = f"""WITH {SAMPLES} SELECT 'cache-' || u AS instance, date, {r(div('rss', 'used'), 3)} AS fragmentation_ratio, COALESCE({div('rss', 'used')} > 1.25, FALSE) AS fragmented,
  expired AS expired_keys, evicted AS evicted_keys, evicted > expired AS evicts_more_than_expires FROM samples"""
ORACLE["M1_run_summary"] = f"""WITH {F_ALL}, {RECS}, {JOBS}, {SCAN}, {TABLES}, {BREAKEVEN}, {PLANS}, {CACHE}, k5 AS ({K5}),
w AS (SELECT resource FROM ({EXPENSIVE}) UNION ALL SELECT resource FROM ({LAYOUT}) UNION ALL SELECT resource FROM ({EXPIRATION}) UNION ALL SELECT resource FROM ({LONG_TERM}))
SELECT 'idle_resources' AS section, 'count' AS metric, CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM f
UNION ALL SELECT 'idle_resources', 'monthly_estimate', CAST(SUM(CAST(monthly_cost_estimate AS DECIMAL(18,2))) FILTER (NOT excluded) AS DOUBLE), NULL FROM f
UNION ALL SELECT 'rightsizing', 'containers', CAST(containers AS DOUBLE), NULL FROM k5
UNION ALL SELECT 'rightsizing', 'over', CAST(over AS DOUBLE), NULL FROM k5
UNION ALL SELECT 'rightsizing', 'under', CAST(under AS DOUBLE), NULL FROM k5
UNION ALL SELECT 'bigquery', 'findings', CAST(COUNT(*) AS DOUBLE), NULL FROM w
UNION ALL SELECT 'bigquery', 'slot_recommendation', NULL, recommendation FROM breakeven
UNION ALL SELECT 'storage', 'buckets', CAST(COUNT(*) AS DOUBLE), NULL FROM plans
UNION ALL SELECT 'storage', 'monthly_saving_estimate', CAST(SUM(CAST(saving AS DECIMAL(18,2))) AS DOUBLE), NULL FROM plans
UNION ALL SELECT 'redis', 'policy', NULL, p || ': ' || CAST(SUM(rec) AS BIGINT) || ' GB' FROM (SELECT {POLICY} AS p, rec FROM c5) GROUP BY p"""
