"""Counters, gauges and align/reduce against brute force."""

import datetime as dt
import random

import pytest

from outlay import fixed
from outlay.operators import metrics as m

T0 = dt.datetime(2026, 9, 1)
SAMPLE = "metric string, cluster string, namespace string, pod string, container string, node string, ts timestamp_ntz, value double"


def sample(metric, pod, at, value, container="app", ns="n", node="node-1"):
    return (metric, "c", ns, pod, container, node, T0 + dt.timedelta(seconds=at), float(value))


def brute_increase(points):
    """Increase per 5-minute cell of a sorted series."""
    out, before = {}, None
    for at, v in points:
        rise = 0.0 if before is None else (v if v < before else v - before)
        out[at // 300] = out.get(at // 300, 0.0) + rise
        before = v
    return out


@pytest.mark.parametrize("step", ["5 minutes", "1 hour"])
def test_counter_increase_with_resets(frame, step):
    rng = random.Random(7)
    rows, want = [], 0.0
    for pod in ("hot-a-1", "b-a-1"):
        at, v, points = 0, 0.0, []
        # One series holds most of the samples.
        for _ in range(3000 if pod.startswith("hot") else 40):
            at += rng.randint(1, 240)
            v = rng.random() if rng.random() < 0.02 else v + rng.random()
            points.append((at, v))
        rows += [sample(fixed.M_CPU_USAGE, pod, a, x) for a, x in points]
        if pod.startswith("hot"):
            want = brute_increase(points)
    got = m.counter_increase(frame(SAMPLE, *rows), m.SERIES, step).filter("pod = 'hot-a-1'").collect()
    assert sum(r["increase"] for r in got) == pytest.approx(sum(want.values()))
    if step == "5 minutes":
        cells = {int((r["grid"] - T0).total_seconds()) // 300: r["increase"] for r in got}
        assert cells == pytest.approx(want)


def test_usage_from_samples(frame):
    rows = []
    for pod, request in (("web-rs-1", 0.25), ("web-rs-2", 0.5)):
        for i in range(20):
            rows += [
                sample(fixed.M_CPU_USAGE, pod, i * 300, i * 30),  # 0.1 cores
                sample(fixed.M_MEM_WORKING_SET, pod, i * 300, (100 + i) * 2**20),
                sample(fixed.M_THROTTLED, pod, i * 300, i), sample(fixed.M_PERIODS, pod, i * 300, i * 2),
                sample(fixed.M_OOM_EVENTS, pod, i * 300, i // 10),
            ]
        rows += [sample(fixed.M_CPU_REQUEST, pod, 0, request), sample(fixed.M_MEM_REQUEST, pod, 0, 2**28)]
    rows += [sample(fixed.M_CPU_USAGE, "web-rs-1", i * 300, i * 900, container="POD") for i in range(20)]
    rows += [sample(fixed.M_CPU_USAGE, "old-rs-1", -86400 * 20, 5), sample(fixed.M_CPU_USAGE, "norequest-rs-1", 5, 5)]
    got = m.usage_from_samples(frame(SAMPLE, *rows), T0 + dt.timedelta(days=1), staleness=dt.timedelta(days=2)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["workload"], r["container"], r["replicas"], r["cpu_request_m"], r["mem_request_mi"]) == ("web", "app", 2, 500.0, 256.0)
    assert r["cpu_p95_m"] == pytest.approx(100) and r["mem_max_mi"] == 119.0 and r["mem_p99_mi"] == pytest.approx(118.81)
    assert (r["throttled_ratio_p95"], r["oom_kills_14d"]) == (pytest.approx(0.5), 1.0)


def test_namespace_panels_need_both_sides(frame):
    rows = [
        sample(fixed.M_CPU_REQUEST, "a", 0, 2), sample(fixed.M_CPU_USAGE, "a", 0, 0), sample(fixed.M_CPU_USAGE, "a", 60, 900),
        sample(fixed.M_CPU_REQUEST, "b", 0, 1, ns="idle"), sample(fixed.M_CPU_USAGE, "x", 0, 1, container="POD"),
    ]
    usage = m.namespace_usage(frame(SAMPLE, *rows))
    assert [(r["namespace"], r["unused"]) for r in m.unused_by_namespace(usage, "cpu").collect()] == [("n", 0.0)]
    assert [r["utilisation_pct"] for r in m.utilisation_by_namespace(usage, "cpu").collect()] == [150.0]
    totals = m.cluster_totals(frame(SAMPLE, *rows), "cpu")
    assert [r["unused"] for r in m.requested_unused(totals).collect()] == [0.0]


def test_candidates_need_every_day(frame):
    rows = []
    for ns, days in (("week", 7), ("gap", 6)):
        for d in range(days):
            at = d * 86400
            rows += [sample(fixed.M_CPU_REQUEST, "p", at, 1, ns=ns), sample(fixed.M_CPU_USAGE, "p", at, d * 30, ns=ns)]
    usage = m.namespace_usage(frame(SAMPLE, *rows), max_gap=dt.timedelta(days=2))
    got = m.rightsizing_candidates(usage, T0 + dt.timedelta(days=7)).collect()
    assert [(r["namespace"], r["cpu_candidate"], r["mem_candidate"]) for r in got] == [("week", True, False)]


def test_align_reduce(frame):
    rows = [("s1", "g", T0, 1.0), ("s1", "g", T0 + dt.timedelta(minutes=30), 3.0), ("s2", "g", T0, 10.0), ("s2", "g", T0 + dt.timedelta(hours=1), 5.0)]
    points = frame("series string, grp string, ts timestamp_ntz, value double", *rows)
    run = lambda a, r: [x["value"] for x in m.align_reduce(points, 3600, a, r, ["series"], ["grp"]).orderBy("period").collect()]
    assert run("mean", "sum") == [12.0, 5.0]
    assert run("p50", "max") == [10.0, 5.0]
    assert run("delta", "sum") == [14.0, 5.0]
    assert run("rate", "sum") == [pytest.approx(14 / 3600), pytest.approx(5 / 3600)]
    bands = m.scorecard(frame("value double", (499.0,), (500.0,), (800.0,))).collect()
    assert [r["band"] for r in bands] == ["GREEN", "YELLOW", "RED"]


def test_nearest_rank(frame):
    points = frame("metric string, k string, value double", *[("m", "a", float(i)) for i in range(1, 11)])
    rank = lambda q: m.nearest_rank(points, ["k"], q).first()["value"]
    assert (rank(0.5), rank(0.95)) == (5.0, 10.0)


def test_budget_and_node_panels(frame):
    pdb = frame("cluster string, namespace string, pdb string, ts timestamp_ntz, value double", ("c", "n", "a", T0, 0.0), ("c", "n", "a", T0 + dt.timedelta(hours=1), 1.0), ("c", "n", "b", T0, 0.0))
    assert [r["pdb"] for r in m.blocking_budgets(pdb, T0 + dt.timedelta(hours=2), dt.timedelta(hours=3)).collect()] == ["b"]
    rows = [
        sample(fixed.M_ALLOC_CPU, "", 0, 4), sample(fixed.M_ALLOC_MEM, "", 0, 2**34),
        sample(fixed.M_CPU_REQUEST, "a", 0, 1), sample(fixed.M_MEM_REQUEST, "a", 0, 2**30), sample(fixed.M_CPU_REQUEST, "b", 0, 0.9),
        sample(fixed.M_ALLOC_CPU, "", 0, 4, node="full"), sample(fixed.M_ALLOC_MEM, "", 0, 2**34, node="full"),
        sample(fixed.M_CPU_REQUEST, "z", 0, 2, node="full"), sample(fixed.M_MEM_REQUEST, "z", 0, 2**30, node="full"),
    ]
    got = m.scale_down_nodes(frame(SAMPLE, *rows), T0 + dt.timedelta(minutes=1)).collect()
    assert [(r["node"], r["cpu_ratio"]) for r in got] == [("node-1", 0.475)]


def busy(pod, cores, seconds, cluster="c", gap=()):
    """Scrapes of a steady series every 30 seconds, but none within ``gap``."""
    rows = [sample(fixed.M_CPU_USAGE, pod, at, at * cores) for at in range(0, seconds, 30) if not (gap and gap[0] <= at < gap[1])]
    return [(r[0], cluster, *r[2:]) for r in rows]


def requests(pod, at, cluster="c"):
    rows = [sample(fixed.M_CPU_REQUEST, pod, at, 1), sample(fixed.M_MEM_REQUEST, pod, at, 2**28)]
    return [(r[0], cluster, *r[2:]) for r in rows]


def test_dead_pods_are_no_replicas(frame):
    rows = [x for i, end in enumerate((3600, 7200, 86_400)) for x in (*busy(f"web-rs-{i}", 0.1, end), *requests(f"web-rs-{i}", end - 30))]
    (r,) = m.usage_from_samples(frame(SAMPLE, *rows), T0 + dt.timedelta(days=1)).collect()
    assert r["replicas"] == 1 and r["cpu_p95_m"] == pytest.approx(100)


def test_clusters_are_kept_apart(frame):
    rows = [x for c, cores in (("a", 0.1), ("b", 0.9)) for x in (*busy("redis-0", cores, 86_400, c), *requests("redis-0", 86_370, c))]
    df, now = frame(SAMPLE, *rows), T0 + dt.timedelta(days=1)
    (r,) = m.usage_from_samples(df, now).collect()
    assert r["cpu_p95_m"] == pytest.approx(900) and r["replicas"] == 2
    (r,) = m.usage_from_samples(df, now, cluster="a").collect()
    assert r["cpu_p95_m"] == pytest.approx(100) and r["replicas"] == 1


def test_a_scrape_gap_is_no_peak(frame):
    rows = [*busy("web-rs-1", 0.5, 86_400, gap=(20_000, 34_400)), *requests("web-rs-1", 86_370)]
    df, now = frame(SAMPLE, *rows), T0 + dt.timedelta(days=1)
    (r,) = m.usage_from_samples(df, now).collect()
    assert r["cpu_max_m"] == pytest.approx(500)
    (r,) = m.usage_from_samples(df, now, max_gap=dt.timedelta(days=1)).collect()
    assert r["cpu_max_m"] > 20_000
    alone = frame(SAMPLE, sample(fixed.M_CPU_USAGE, "p", 0, 0), sample(fixed.M_CPU_USAGE, "p", 9000, 99))
    assert [r["value"] for r in m.counter_rate(alone, m.SERIES).collect()] == [0.0]


def test_gone_series_do_not_hold_a_node(frame):
    rows = [
        sample(fixed.M_ALLOC_CPU, "", 0, 4), sample(fixed.M_ALLOC_MEM, "", 0, 2**34), sample(fixed.M_CPU_REQUEST, "a", 0, 0.5), sample(fixed.M_MEM_REQUEST, "a", 0, 2**30),
        sample(fixed.M_CPU_REQUEST, "gone", -86_400 * 200, 3.5), sample(fixed.M_ALLOC_CPU, "", -86_400, 4, node="old"), sample(fixed.M_ALLOC_MEM, "", -86_400, 2**34, node="old"),
    ]
    got = m.scale_down_nodes(frame(SAMPLE, *rows), T0 + dt.timedelta(minutes=1)).collect()
    assert [(r["cluster"], r["node"], r["cpu_ratio"]) for r in got] == [("c", "node-1", 0.125)]
