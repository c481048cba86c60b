"""Oracle SQL of the primitives."""

from __future__ import annotations

from outlay.oracle.billing import AS_OF, ASSET_NAME, CUD, DISKS, EGRESS, LINES, SUD, d, div, meaning, r

PID = "COALESCE(project_id, '(account)')"
W = f"WITH {LINES}"
DAILY = f"daily AS (SELECT usage_date, {PID} AS project_id, service, SUM(net) AS net_cost FROM lines GROUP BY ALL)"
G = "g AS (SELECT invoice_month, service, SUM(net) AS net FROM lines GROUP BY ALL)"
CREDITS = """credit AS (SELECT c1_type AS t, c1_amount AS a FROM lines WHERE c1_type IS NOT NULL UNION ALL SELECT c2_type, c2_amount FROM lines WHERE c2_type IS NOT NULL
  UNION ALL SELECT c1_type, 0 FROM lines, range(4) WHERE c1_type IS NOT NULL AND l_orderkey % 4 = 0)"""
MEANING = meaning("t")
SPEC = "CASE WHEN family = 'n2' THEN 'n2-standard-4' WHEN family = 'e2' THEN 'e2-standard-2' WHEN family = 'c2' THEN 'c2-standard-8' END"
ORACLE: dict[str, str] = {
    "P1_net_cost": f"{W} SELECT service, {d('SUM(cost)')} AS cost, {d('SUM(net)')} AS net_cost FROM lines GROUP BY ALL",
    "P2_typed_credits": f"{W} SELECT service, {d(f'SUM({CUD})')} AS cud, {d(f'SUM({SUD})')} AS sud FROM lines GROUP BY ALL",
    "P3_label_lookup": f"{W} SELECT r_team AS team, {SPEC} AS machine_spec, COUNT(*) AS lines FROM lines GROUP BY ALL",
    "P4_label_fallback": f"{W} SELECT COALESCE(p_env, r_env, '(unlabelled)') AS env, COALESCE(p_cc, '(unlabelled)') AS cost_center, COUNT(*) AS lines FROM lines GROUP BY ALL",
    "P5_label_exists": f"{W} SELECT service, COUNT(*) AS lines FROM lines WHERE cluster IS NOT NULL GROUP BY ALL",
    "P6_unnest_keep_empty": f"""{W}, {CREDITS} SELECT t AS credit_type, COUNT(*) AS rows_total, {d('SUM(a)')} AS amount
  FROM (SELECT * FROM credit UNION ALL SELECT NULL, NULL FROM lines WHERE c1_type IS NULL AND c2_type IS NULL) GROUP BY ALL""",
    "P7_regex_classes": f"{W} SELECT {EGRESS} AS egress_class, COUNT(*) AS lines FROM lines WHERE regexp_matches(sku, '(?i)egress|network.*(internet|inter)') GROUP BY ALL",
    "P8_like_filter": f"{W} SELECT service, COUNT(*) AS lines FROM lines WHERE is_disk GROUP BY ALL",
    "P9_predicates": f"""{W} SELECT service, {PID} AS project_id, COUNT(*) AS lines FROM lines WHERE ((service IN ('Compute Engine', 'Kubernetes Engine')
  AND usage_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31') OR project_id IS NULL) AND cost_type <> 'tax' GROUP BY ALL""",
    "P10_conditional_sum": f"""{W} SELECT {PID} AS project_id, {d("SUM(CASE WHEN cost_type = 'tax' THEN cost ELSE 0 END)")} AS tax, {d("SUM(CASE WHEN cost_type = 'tax' THEN 0 ELSE cost END)")} AS regular FROM lines GROUP BY ALL""",
    "P11_safe_arithmetic": f"""{W}, s AS (SELECT usage_date AS day, SUM(cost) AS cost, COALESCE(SUM(cost) FILTER (cost_type = 'tax'), 0) AS tax FROM lines GROUP BY ALL)
SELECT day, {r(div('cost', 'tax'))} AS cost_per_tax, {d('ABS(GREATEST(tax, cost * CAST(0.1 AS DECIMAL(2,1))) - cost)', 1)} AS distance FROM s""",
    "P12_window_over_aggregate": f"{W}, {G} SELECT invoice_month, service, {d('net')} AS net, {r(div('net', 'SUM(net) OVER (PARTITION BY invoice_month)') + ' * 100')} AS share_pct FROM g",
    "P13_grand_total_share": f"{W}, {G} SELECT invoice_month, service, {r(div('net', 'SUM(net) OVER ()') + ' * 100', 4)} AS share_pct FROM g",
    "P14_having_rounded": f"{W}, {G} SELECT invoice_month, service, CAST(ROUND(net / 100000, 0) * 100000 AS DOUBLE) AS net FROM g WHERE ROUND(net / 100000, 0) * 100000 >= 200000",
    "P15_latest_version": f"""WITH {DISKS} SELECT {ASSET_NAME} AS asset_name,
  CASE l_linenumber WHEN 1 THEN 'true' WHEN 2 THEN 'no' END AS keep_label, CASE WHEN l_linenumber <> 3 THEN l_shipdate + INTERVAL 390 MINUTE END AS last_detach FROM latest""",
    "P23_json_fields": """SELECT CAST(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 0 END AS INTEGER) AS users, CASE l_linenumber WHEN 1 THEN 'true' WHEN 2 THEN 'no' END AS keep, COUNT(*) AS versions
  FROM lineitem GROUP BY ALL""",
    "P16_range_frame": f"""{W}, {DAILY} SELECT usage_date, project_id, service, {r('AVG(CAST(net_cost AS DOUBLE)) OVER w')} AS mean, {r('STDDEV_SAMP(CAST(net_cost AS DOUBLE)) OVER w')} AS deviation, COUNT(net_cost) OVER w AS n
  FROM daily WINDOW w AS (PARTITION BY project_id, service ORDER BY usage_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    "P17_calendar": f"""{W}, d AS (SELECT service, usage_date, COUNT(*) AS n FROM lines GROUP BY ALL),
s AS (SELECT service, CAST(UNNEST(generate_series(MIN(usage_date), MAX(usage_date), INTERVAL 1 DAY)) AS DATE) AS usage_date FROM d GROUP BY service)
SELECT service, usage_date, COALESCE(n, 0) AS lines FROM s LEFT JOIN d USING (service, usage_date)""",
    "P18_distinct_keys": f"{W} SELECT DISTINCT {PID} AS project_id, service, CAST({AS_OF} - o AS DATE) AS usage_date FROM lines, (VALUES (0), (1), (2)) t(o)",
    "P19_left_join": f"""{W}, {DAILY} SELECT a.usage_date, a.project_id, a.service, {d('a.net_cost')} AS net_cost, {d('b.net_cost')} AS week_before
  FROM daily a LEFT JOIN daily b ON b.usage_date + 7 = a.usage_date AND b.project_id = a.project_id AND b.service = a.service""",
    "P20_inner_join": f"""{W}, p AS (SELECT invoice_month, {PID} AS project_id, SUM(cost) AS cost FROM lines GROUP BY ALL), t AS (SELECT invoice_month, SUM(cost) AS listed FROM lines GROUP BY ALL)
SELECT invoice_month, project_id, {r(div('cost', 'listed') + ' * 100')} AS pct FROM p JOIN t USING (invoice_month)""",
    "P21_date_functions": f"""{W} SELECT CAST(date_trunc('month', usage_date) AS DATE) AS month, CAST(CAST(export_ts AS DATE) - usage_date AS INTEGER) AS lag_days, CAST(MIN(usage_date - DATE '1970-01-01') AS INTEGER) AS first_day_number,
  MAX(usage_date) - 30 AS window_start, DATE '2000-03-01' AS months_start, COUNT(*) AS lines FROM lines GROUP BY ALL""",
    "P22_split_first_token": f"{W} SELECT family AS machine_family, COUNT(*) AS lines FROM lines GROUP BY ALL",
    "P24_code_texts": f"{W}, {CREDITS} SELECT t AS credit_type, COUNT(*) AS credits, {MEANING} AS meaning FROM credit GROUP BY ALL",
    "P25_order_by": f"{W}, {G} SELECT invoice_month, service, {d('net')} AS net_cost FROM g ORDER BY 1 DESC, 3 DESC",
    "P26_top_n": f"""{W}, g AS (SELECT '//compute.googleapis.com/projects/p/zones/z/' || CASE WHEN is_disk THEN 'disks/disk-' ELSE 'instances/vm-' END || l_partkey AS global_name, SUM(cost) AS cost FROM lines GROUP BY ALL)
SELECT global_name, {d('cost')} AS cost FROM g ORDER BY g.cost DESC, 1 LIMIT 20""",
    "P27_script_parameters": f"{W} SELECT service, COUNT(*) AS lines FROM lines WHERE usage_date BETWEEN {AS_OF} - 30 AND {AS_OF} GROUP BY ALL",
}
