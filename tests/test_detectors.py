"""Branches and golden values of the detectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.dates import age_days
from outlay.functions.money import fmt_bytes, fmt_money, round_up
from outlay.operators import cache, findings, inventory, rightsizing, storage, warehouse
from outlay.plans import cleanup
from outlay.sources import documents

P = fixed.DEFAULT_PRICES
NOW = dt.datetime(2026, 9, 21, 2, 0, 0)
DISK = "name string, zone string, type string, size_gb int, users array<string>, labels map<string,string>, last_attach_timestamp timestamp_ntz, last_detach_timestamp timestamp_ntz, creation_timestamp timestamp_ntz"


def ago(days, seconds=0):
    return NOW - dt.timedelta(days=days, seconds=seconds)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_unattached_disks(frame, now):
    got = by(
        inventory.unattached_disks(
            frame(
                DISK,
                ("big", "z", "pd-ssd", 500, [], {}, None, None, ago(20)),
                ("small", "z", "pd-odd", 100, None, None, ago(3), None, ago(90)),
                ("kept", "z", "pd-ssd", 500, [], {"keep": "TRUE"}, None, None, ago(20)),
                ("used", "z", "pd-ssd", 500, ["vm"], {}, None, None, ago(20)),
            ),
            P,
            now,
        ),
        "resource",
    )
    assert set(got) == {"z/disks/big", "z/disks/small", "z/disks/kept"}
    big, small, kept = (got[f"z/disks/{n}"] for n in ("big", "small", "kept"))
    assert (big["severity"], big["monthly_cost_estimate"]) == ("high", 102.0)
    assert big["recommendation"] == "Snapshot then delete (unattached 20d). Snapshot cost ~16.00 USD/mo"
    assert (small["severity"], small["monthly_cost_estimate"]) == ("medium", 12.0)
    assert (kept["severity"], kept["excluded"]) == ("medium", True)


def test_age_is_whole_periods(frame, now):
    df = frame("t timestamp_ntz", (ago(0, 7201),), (ago(1),), (NOW + dt.timedelta(days=3),))
    assert sorted(r[0] for r in df.select(age_days(F.col("t"), now)).collect()) == [0, 0, 1]


def test_stopped_instances(frame, now):
    schema = "name string, zone string, machine_type string, status string, labels map<string,string>, last_stop_timestamp timestamp_ntz, disks array<struct<name:string,size_gb:int,type:string>>"
    vms = frame(schema, ("a", "z", "m", "TERMINATED", {}, ago(11), [("d", 100, "pd-balanced")]), ("b", "z", "m", "TERMINATED", {}, None, []), ("c", "z", "m", "RUNNING", {}, ago(99), []))
    assert inventory.stopped_instances(vms, P, now).count() == 0
    rows = inventory.stopped_instances(vms, P, now, min_days=5).collect()
    assert [(r["resource"], r["monthly_cost_estimate"]) for r in rows] == [("z/instances/a", 12.0)]


def test_snapshots_pools_rules_and_sql(frame, now):
    snaps = frame("name string, source_disk string, storage_bytes bigint, creation_timestamp timestamp_ntz, labels map<string,string>", ("old", "d", 400 * 2**30, ago(90), {}), ("young", "d", 2**30, ago(89), {}))
    assert [(r["severity"], r["monthly_cost_estimate"]) for r in inventory.old_snapshots(snaps, P, now).collect()] == [("medium", 12.8)]
    pools = frame(
        "cluster string, location string, name string, machine_type string, node_count int, autoscaling struct<enabled:boolean,min:int,max:int>, spot boolean, running_pods_excluding_daemonsets int",
        ("c", "l", "idle", "e2-standard-4", 4, (True, 0, 4), False, 0), ("c", "l", "spot", "e2-standard-4", 4, None, True, 0),
        ("c", "l", "unknown", "e2-standard-4", 4, None, None, None), ("c", "l", "zero", "e2-standard-4", 0, None, None, 0),
    )
    costs = {r["resource"]: r["monthly_cost_estimate"] for r in inventory.empty_node_pools(pools, P).collect()}
    assert costs == {"c/nodePools/idle": 432.16, "c/nodePools/spot": pytest.approx(151.26, abs=0.01)}
    rules = frame("name string, region string, load_balancing_scheme string, target string, backend_service_healthy_backends int, backends_total int", ("a", "r", "E", "t", 0, None), ("b", "r", "E", "t", None, 0))
    assert [r["monthly_cost_estimate"] for r in inventory.lbs_without_backends(rules, P).collect()] == [21.9]
    dbs = frame(
        "name string, region string, tier string, state string, storage_gb int, connections_p95_14d int, cpu_utilization_avg_14d double, labels map<string,string>",
        ("a", "r", "db-custom-4-15360", "RUNNABLE", 250, 0, 0.1, {}), ("b", "r", "db-f1-micro", "RUNNABLE", 0, 1, 0.1, {}),
        ("c", "r", "db-f1-micro", "RUNNABLE", 0, None, 0.1, {}), ("d", "r", "db-f1-micro", "STOPPED", 0, 0, 0.1, {}),
    )
    assert {r["resource"]: r["monthly_cost_estimate"] for r in inventory.unused_sql(dbs, P).collect()} == {"r/sql/a": 277.3, "r/sql/b": 113.15}


def test_idle_addresses(frame, now):
    schema = "name string, region string, address string, status string, address_type string, users array<string>, creation_timestamp timestamp_ntz, labels map<string,string>"
    rows = inventory.idle_addresses(frame(schema, ("a", "r", "1.2.3.4", "RESERVED", "E", [], ago(7), {}), ("b", "r", "1.2.3.5", "IN_USE", "E", [], ago(7), {})), P, now).collect()
    assert [(r["monthly_cost_estimate"], r["recommendation"]) for r in rows] == [(8.76, "Release reserved IP 1.2.3.4 (unused 7d)")]


def finding_rows(frame, *rows):
    schema = "category string, resource string, severity string, monthly_cost_estimate double, recommendation string, excluded boolean, details string"
    return frame(schema, *[(c, r, s, m, "", e, "{}") for c, r, s, m, e in rows])


def test_findings_order_totals_and_delta(frame):
    old = finding_rows(frame, ("x", "a", "low", 1.0, False), ("x", "b", "high", 1.0, False), ("x", "c", "high", 100.0, True), ("y", "d", "medium", 5.0, False))
    assert [r["resource"] for r in findings.sort_findings(old).collect()] == ["c", "b", "d", "a"]
    total = findings.report_totals(old).first()
    assert (total["actionable"], total["excluded"], total["actionable_run_rate"], total["total_monthly_estimate"]) == (3, 1, 7.0, 107.0)
    assert by(findings.category_rollup(old), "category")["x"]["findings"] == 2
    new = finding_rows(frame, ("x", "a", "low", 1.0, False), ("x", "b", "high", 2.5, False), ("z", "e", "low", 3.0, False))
    changes = {r["resource"]: (r["change"], r["cost_delta"]) for r in findings.findings_delta(old, new).collect()}
    assert changes == {"a": ("unchanged", 0.0), "b": ("changed", 1.5), "c": ("resolved", -100.0), "d": ("resolved", -5.0), "e": ("new", 3.0)}


USAGE = "namespace string, workload string, kind string, container string, replicas int, cpu_request_m int, mem_request_mi int, mem_limit_mi int, cpu_p95_m double, cpu_p99_m double, mem_p99_mi double, mem_max_mi double, oom_kills_14d int, throttled_ratio_p95 double"
GOLDEN = [
    # replicas, request, p95/p99, mem p99/max, oom, throttle -> cpu, mem, status, delta
    ((6, 1000, 2048, 210.0, 310.0, 680.0, None, 0, 0.01), (300, 832, "over", -90.84)),
    ((4, 500, 1024, 780.0, 940.0, 980.0, 1020.0, 3, 0.42), (1250, 1248, "under", 55.04)),
    ((8, 250, 512, 240.0, 290.0, 500.0, None, 0, 0.08), (350, 608, "under", 15.88)),
    ((1, 4000, 16384, 3600.0, 3900.0, 12800.0, None, 0, 0.05), (4700, 15360, "under", 10.03)),
    ((10, 100, 128, 45.0, 70.0, 104.0, None, 0, 0.0), (100, 128, "ok", 0.0)),
]


def usage(frame, *specs, kind="Deployment"):
    return frame(USAGE, *[("n", f"w{i}", kind, "c", r, c, m, m, p95, p99, m99, mx, oom, thr) for i, (r, c, m, p95, p99, m99, mx, oom, thr) in enumerate(specs)])


def test_recommendations_golden(frame):
    got = by(rightsizing.recommend(usage(frame, *[g[0] for g in GOLDEN]), P), "workload")
    for i, (_, want) in enumerate(GOLDEN):
        r = got[f"w{i}"]
        assert (r["rec_cpu_request_m"], r["rec_mem_request_mi"], r["status"], r["monthly_delta_estimate"]) == want
    assert got["w1"]["notes"] == ["3 OOMKills in window; memory raised to max+headroom", "CPU throttled 42% of periods at p95; raise request/relax limit"]
    assert got["w3"]["notes"] == ["Mixed change: one resource rises while the other falls"]


def test_recommendation_options(frame):
    spec = (2, 1000, 2048, 100.0, 400.0, 200.0, None, 1, 0.0)
    plain = rightsizing.recommend(usage(frame, spec), P).first()
    vetoed = rightsizing.recommend(usage(frame, spec), P, veto_downward=True).first()
    assert plain["rec_cpu_request_m"] == 550 and vetoed["rec_cpu_request_m"] == 1000
    limited = rightsizing.recommend(usage(frame, spec, kind="CronJob"), P, cpu_limits="2x").first()
    assert limited["rec_cpu_limit_m"] == 1100 and limited["notes"][-1].startswith("Batch workload")
    no_request = rightsizing.recommend(usage(frame, (1, 0, 0, 10.0, 10.0, 10.0, None, 0, 0.0)), P).first()
    assert (no_request["rec_cpu_request_m"], no_request["rec_mem_request_mi"], no_request["status"]) == (50, 32, "under")


def test_vpa_comparison_last_wins(frame):
    recs = rightsizing.recommend(usage(frame, GOLDEN[0][0]), P)
    vpa = frame("namespace string, workload string, container string, target_cpu_m int, target_mem_mi int, seq bigint", ("n", "w0", "c", 300, 700, 1), ("n", "w0", "c", 100, 720, 2))
    row = rightsizing.attach_vpa(recs, vpa).first()
    assert (row["vpa_target_cpu_m"], row["vpa_target_mem_mi"]) == (100, 720)
    assert row["notes"][-1] == "Diverges from VPA target by 200% on CPU; inspect before applying"


def test_summary_and_patch(frame):
    recs = rightsizing.recommend(usage(frame, *[g[0] for g in GOLDEN], kind="CronJob"), P)
    s = rightsizing.summary(recs).first()
    assert (s["containers"], s["over"], s["under"], s["ok"], s["monthly_reduction"], s["monthly_increase"]) == (5, 1, 3, 1, 90.84, 80.95)
    docs = by(rightsizing.patch_docs(recs), "workload")
    assert "w4" not in docs and docs["w0"]["patch"].startswith('{"apiVersion":"batch/v1","kind":"CronJob"')
    assert '"jobTemplate":{"spec":{"template":{"spec":{"containers":[{"name":"c"' in docs["w0"]["patch"]


@pytest.mark.parametrize("avg_slots, baseline", [(6.6, 100), (100.0, 200), (149.0, 200), (200.0, 200), (260.0, 300)])
def test_slot_baseline_rounds_half_even(frame, avg_slots, baseline):
    jobs = frame("total_slot_ms bigint, total_bytes_billed bigint", (int(avg_slots * 720 * 3_600_000), 0))
    row = warehouse.slot_breakeven(jobs, P).first()
    assert row["slots_standard_monthly"] == pytest.approx(baseline * 0.048 * 730)


def test_slot_verdicts(frame):
    for tib, start in ((2000, "Move to a 100-slot"), (100, "Stay"), (560, "Near")):
        jobs = frame("total_slot_ms bigint, total_bytes_billed bigint", (0, tib * 2**40))
        assert warehouse.slot_breakeven(jobs, P).first()["recommendation"].startswith(start)


TABLE = "table string, total_logical_bytes bigint, active_logical_bytes bigint, long_term_logical_bytes bigint, partitioning string, clustering array<string>, partition_expiration_days int, last_modified_days_ago int, typical_filter_columns array<string>"
JOB = "query_hash string, user_email string, label_team string, run_count bigint, total_bytes_billed bigint, referenced_tables array<string>, sample_sql string"


def table(name, gb=100, part=None, clus=(), cols=(), exp=None, ago_days=1):
    return (name, gb * 10**9, gb * 10**9, gb * 10**8, part, list(clus), exp, ago_days, list(cols))


def test_table_layout_branches(frame):
    jobs = frame(JOB, ("q", "u", "t", 1, 8 * 2**40, ["a", "b", "c", "d"], ""), ("r", "u", "t", 1, 2**40, [], ""))
    tables = frame(
        TABLE,
        table("a", cols=["id", "event_date"]),
        table("b", cols=["id"]),
        table("c", part="DAY", cols=["id"]),
        table("d", gb=9, cols=["event_date"]),
        table("e", cols=["id"]),
        table("f", cols=["candidate_id"]),
    )
    got = by(warehouse.table_layout(tables, jobs, P), "resource")
    assert set(got) == {"a", "b", "c", "f"}
    assert (got["a"]["category"], got["a"]["monthly_cost_estimate"]) == ("unpartitioned-table", 10.0)
    assert got["b"]["recommendation"].startswith("No date column") and got["c"]["recommendation"].startswith("Add clustering on (id)")
    # The heuristic works on substrings.
    assert "DATE(candidate_id)" in got["f"]["recommendation"]
    ddl = by(warehouse.suggested_ddl(warehouse.table_layout(tables, jobs, P)), "resource")
    assert "CLUSTER BY id\n" in ddl["a"]["ddl"] and "CLUSTER BY" not in ddl["f"]["ddl"]


def test_expiration_and_long_term(frame):
    tables = frame(TABLE, table("stale", part="DAY", ago_days=60), table("big", gb=12000, part="DAY"), table("set", part="DAY", exp=30, ago_days=90), table("hot", gb=2000))
    got = by(warehouse.partition_expiration(tables, P), "resource")
    assert {k: v["severity"] for k, v in got.items()} == {"stale": "medium", "big": "low"}
    assert got["big"]["recommendation"].startswith("10% of partitions")
    assert [r["resource"] for r in warehouse.long_term_candidates(tables, P).collect()] == ["hot"]


def test_expensive_query_hints(frame):
    jobs = frame(JOB, ("q1", "u", "t", 720, 800 * 2**40, ["a"], "select * from x"), ("q2", "u", "t", 1, 2**30, [], "select 1"))
    top = by(warehouse.expensive_queries(jobs, P), "resource")
    assert top["q1"]["recommendation"] == "avoid SELECT *; runs 24x/day: materialise into a scheduled table or BI Engine; 1.1 TiB per run: add partition filter / require_partition_filter"
    assert (top["q1"]["severity"], top["q2"]["recommendation"]) == ("high", "Review query plan for pruning opportunities")


def test_query_rollup_normalises_blanks(spark, frame):
    schema = "job_id bigint, query string, user_email string, labels array<struct<key:string,value:string>>, creation_time timestamp_ntz, start_time timestamp_ntz, end_time timestamp_ntz, job_type string, state string, error_result string, total_bytes_billed bigint, total_slot_ms bigint"
    row = lambda i, q, **kw: (i, q, f"u{i}", [("team", "a")], kw.get("t", NOW), NOW, NOW + dt.timedelta(seconds=10 * i), "QUERY", kw.get("state", "DONE"), kw.get("err"), 5, 1)
    log = frame(schema, row(2, "select  1"), row(1, "select\n1"), row(3, "select 2"), row(4, "select 1", err="x"), row(5, "select 1", t=NOW - dt.timedelta(days=31)))
    got = by(warehouse.query_rollup(log, NOW, top=1), "run_count")
    assert set(got) == {2} and (got[2]["user_email"], got[2]["avg_duration_s"], got[2]["total_bytes_billed"]) == ("u1", 15.0, 10)


BUCKET = "name string, storage_class string, versioning boolean, lifecycle_rules array<string>, labels map<string,string>, access_pattern struct<class_a_ops_30d:bigint,class_b_ops_30d:bigint,egress_gb_30d:double,last_read_age_days_p50:int>, age_distribution_bytes map<string,bigint>, noncurrent_bytes bigint"
DIST = {"0-30": 10**12, "30-90": 10**12, "90-365": 10**12, "365+": 10**12}


def plan(frame, cls="STANDARD", versioning=False, access=(None, None, None, None), noncurrent=0, rules=(), labels=None, **kw):
    labels = {"env": "a", "team": "b"} if labels is None else labels
    return storage.bucket_plans(frame(BUCKET, ("b", cls, versioning, list(rules), labels, access, DIST, noncurrent)), P, **kw).first()


def test_bucket_plans(frame):
    cold = plan(frame)
    assert (cold["current_monthly"], cold["proposed_monthly"], cold["saving"]) == (92.0, 44.5, 47.5)
    assert [(r["action"]["storageClass"], r["condition"]["age"], r["condition"]["matchesStorageClass"]) for r in cold["rules"]] == [
        ("NEARLINE", 30, ["STANDARD"]), ("COLDLINE", 90, ["STANDARD", "NEARLINE"]), ("ARCHIVE", 365, ["STANDARD", "NEARLINE", "COLDLINE"]),
    ]
    warm = plan(frame, access=(None, None, None, 30))
    assert [r["action"]["storageClass"] for r in warm["rules"]] == ["NEARLINE", "COLDLINE"]
    hot = plan(frame, access=(0, 10_000_001, 0.0, 999))
    assert hot["rules"] == [] and hot["saving"] == 0.0 and hot["notes"][0].startswith("Hot serving")
    near = plan(frame, cls="NEARLINE")
    assert [r["action"]["storageClass"] for r in near["rules"]] == ["COLDLINE", "ARCHIVE"] and near["proposed_monthly"] == 34.5
    assert near["rules"][0]["condition"]["matchesStorageClass"] == ["NEARLINE"]


def test_noncurrent_retrieval_and_guard(frame):
    v = plan(frame, versioning=True, noncurrent=10**12)
    assert len(v["rules"]) == 5 and v["proposed_monthly"] == 49.1 and v["current_monthly"] == 115.0
    assert plan(frame, noncurrent=10**12)["proposed_monthly"] == 67.5
    # 1000 GB read, three quarters cold: .75 * .25 * (.01 + .02 + .05) * 1000
    assert plan(frame, access=(0, 0, 1000.0, 999))["proposed_monthly"] == 59.5
    assert plan(frame, labels={"env": "a"}, rules=["x"])["notes"] == ["1 lifecycle rule(s) already present; proposal replaces them", "Missing required labels (env/team); showback attribution incomplete"]


CONFIG = "instance string, provider string, tier string, provisioned_memory_gb int, maxmemory_bytes bigint, maxmemory_policy string, ops_per_sec_p95 int, ttl_coverage_ratio double, big_keys array<struct<key_pattern:string,count:bigint,avg_bytes:bigint,ttl_set:boolean>>"
SAMPLE = "instance string, date date, used_memory bigint, keyspace_hits bigint, keyspace_misses bigint, evicted_keys bigint"


def cache_plan(frame, used=(2.0, 2.5, 3.0), ttl=0.62, ops=9000, tier="STANDARD_HA", policy="noeviction", keys=()):
    config = frame(CONFIG, ("c", None, tier, 5, 4 * 2**30, policy, ops, ttl, list(keys)))
    samples = frame(SAMPLE, *[("c", dt.date(2026, 9, 1) + dt.timedelta(days=2 * i), int(u * 2**30), 75, 25, i) for i, u in enumerate(used)])
    return cache.capacity_plan(config, samples, P).first()


def test_cache_plan(frame):
    r = cache_plan(frame)
    assert (r["growth_gb_per_day"], r["days_to_maxmemory"], r["projected_90d_gb"], r["hit_ratio"], r["utilisation"]) == (0.25, 4.0, 25.5, 0.75, 0.75)
    assert (r["recommended_gb"], r["recommended_shards"], r["recommended_policy"]) == (32, 3, "allkeys-lru")
    assert (r["current_monthly_estimate"], r["recommended_monthly_estimate"]) == (156.95, 1004.48)
    assert r["actions"][0] == "At current growth (256 MiB/day) maxmemory is reached in ~4 days; resize or add eviction before then"


def test_cache_branches(frame):
    flat = cache_plan(frame, used=(2.0, 2.0, 2.0), ttl=0.95, policy="volatile-lru")
    assert (flat["days_to_maxmemory"], flat["growth_gb_per_day"], flat["recommended_policy"]) == (None, 0.0, "volatile-lru")
    assert cache_plan(frame, used=(2.0,))["growth_gb_per_day"] == 0.0
    assert cache_plan(frame, used=(2.0, 2.0), ops=120_000)["recommended_shards"] == 5
    assert cache_plan(frame, used=(2.0,), tier="BASIC", ttl=0.1)["recommended_policy"] == "allkeys-lfu"
    keys = [("k", 1000, 2**20, False), ("t", 1000, 2**20, True), ("b", 1, 400 * 2**20, False)]
    texts = cache_plan(frame, used=(2.0,), keys=keys)["actions"]
    assert any("`k` holds 0.98 GiB" in t for t in texts) and any("`b`" in t for t in texts) and not any("`t`" in t for t in texts)
    assert any(t.startswith("Big key") for t in texts)


@pytest.mark.parametrize("need, size", [(0.5, 1), (6.1, 8), (300.0, 300), (301.0, 350), (350.0, 350), (351.0, 400)])
def test_size_step(frame, need, size):
    assert frame("x double", (need,)).select(cache.size_step(F.col("x"))).first()[0] == size


def test_helpers(frame):
    df = frame("x double", (101.0,), (0.0,), (33.0,))
    assert sorted(tuple(r) for r in df.select("x", round_up(F.col("x"), 50), round_up(F.col("x"), 32)).collect()) == [(0.0, 50, 32), (33.0, 50, 64), (101.0, 150, 128)]
    one = frame("m double, b bigint", (1234.5, 2**30))
    assert tuple(one.select(fmt_money(F.col("m")), fmt_bytes(F.col("b"))).first()) == ("1,234.50 USD", "1.0 GiB")


def test_cleanup_plans(frame, now):
    disks = frame(
        DISK,
        ("never", "z", "t", 1, [], {}, None, None, ago(31)), ("recent", "z", "t", 1, [], {}, None, ago(3), ago(99)),
        ("kept", "z", "t", 1, [], {"keep": "true"}, None, ago(40), ago(99)), ("Kept", "z", "t", 1, [], {"keep": "TRUE"}, None, ago(40), ago(99)),
    )
    plan_rows = [(r["resource"], r["decision"], r["action"]) for r in cleanup.disk_plan(disks, now).collect()]
    assert ("kept", "SKIP", "skip") in plan_rows and ("never", "PLAN", "snapshot pre-delete-never-20260921") in plan_rows
    assert ("Kept", "PLAN", "delete") in plan_rows and len(plan_rows) == 5
    assert cleanup.disk_plan(disks, now, snapshot_first=False).count() == 3
    snaps = frame("name string, creation_timestamp timestamp_ntz, labels map<string,string>", ("own", ago(99), {"source": "cleanup"}), ("free", ago(99), None), ("other", ago(99), {"source": "x"}))
    assert {r["resource"] for r in cleanup.snapshot_plan(snaps, now).collect()} == {"free", "other"}
    ips = frame("name string, region string, address string, status string, labels map<string,string>, creation_timestamp timestamp_ntz", ("g", None, "1", "RESERVED", None, ago(99)), ("r", "r1", "2", "RESERVED", None, ago(99)))
    assert {r["resource"]: r["scope"] for r in cleanup.address_plan(ips, now).collect()} == {"g": "global", "r": "r1"}
    counts = cleanup.plan_counts(cleanup.combined_plan({"disks": disks, "snapshots": snaps, "addresses": ips}, now, only="disks")).collect()
    assert {(r["decision"], r["resources"]) for r in counts} == {("PLAN", 2), ("SKIP", 1)}
    with pytest.raises(ValueError):
        cleanup.combined_plan({}, now, only="vms")


def test_schedule_plan(frame):
    lines = frame("value string", ("# project cluster", ), ("", ), ("p-dev  dev\tloc  pool 2",), ("p-prod dev loc other 3",))
    pools = documents.parse_pools(lines)
    auto = frame("project string, cluster string, location string, pool string, autoscaling_enabled boolean", ("p-dev", "dev", "loc", "pool", True), ("p-dev", "other", "loc", "pool", False))
    up = by(cleanup.schedule_plan(pools, "up", auto), "pool")
    assert (up["pool"]["target_nodes"], up["pool"]["autoscale_min"], up["pool"]["autoscale_max"]) == (2, 2, 8)
    assert (up["other"]["decision"], up["other"]["target_nodes"]) == ("REFUSE", None)
    assert by(cleanup.schedule_plan(pools, "down"), "pool")["pool"]["target_nodes"] == 0


def test_broken_documents_stop_the_job(frame):
    for text in ('{"disks": [{"name": "d", "size_gb": 10', '{"disks": [{"name": "d", "size_gb": "100"}]}'):
        with pytest.raises(Exception, match="(?i)malformed|failfast"):
            documents.parse_inventory(frame("value string", (text,)))["disks"].collect()
