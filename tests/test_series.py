"""The stored daily series: restatement of late days, merged moments, repeated runs."""

import datetime as dt
import glob
import os
import re
import statistics

import pytest
from pyspark.sql import functions as F
from test_billing import line
from test_physical_plans import plan

from outlay import schemas
from outlay.operators import anomalies, series
from outlay.streaming import jobs

DAY = dt.date(2026, 9, 1)


def day(n, arrives=0, **kw):
    """A line of day ``n`` that is exported and ingested ``arrives`` days later."""
    used = DAY + dt.timedelta(days=n)
    row = line(day=used, ingest=used + dt.timedelta(days=arrives), **kw)
    return row | {"export_time": dt.datetime.combine(row["ingest_date"], dt.time(6))}


def night(n):
    return dt.datetime.combine(DAY + dt.timedelta(days=n), dt.time(23))


def stated(store):
    rows = store.days().select("usage_date", "project_id", "service", F.col("net_cost").cast("double")).collect()
    return sorted(((r[0] - DAY).days, *r[1:]) for r in rows)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/days/**/*.parquet", recursive=True) + glob.glob(f"{path}/blocks/**/*.parquet", recursive=True)}


@pytest.fixture
def export(spark, tmp_path):
    def make(*rows):
        path = str(tmp_path / "export")
        spark.createDataFrame(list(rows), schemas.BILLING_LINE).write.partitionBy("ingest_date").mode("append").parquet(path)
        return spark.read.schema(schemas.BILLING_LINE).parquet(path)

    return make


def test_late_lines_restate_only_their_days(spark, export, tmp_path):
    store = series.DailySeries(spark, str(tmp_path / "series"), DAY)
    lines = export(*[day(n, cost="10") for n in range(12)], day(3, cost="7", cost_type="tax"), day(-1, cost="99"))
    assert store.update(lines, night(11)) == [DAY + dt.timedelta(days=n) for n in range(12)]
    before = files(store.path)
    # Nine days late, far behind any watermark; and a first line of a new key.
    lines = export(day(3, arrives=9, cost="5", credits=[("A", "-1")]), day(12, project="p2"), day(5, arrives=8, cost="1", cost_type="tax"))
    assert store.update(lines, night(12)) == [DAY + dt.timedelta(days=n) for n in (3, 12)]
    want = [(n, "p1", "Compute Engine", 14.0 if n == 3 else 10.0) for n in range(12)] + [(12, "p2", "Compute Engine", 10.0)]
    assert stated(store) == want
    after = files(store.path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {re.search(r"usage_date=(\S+?)/", f)[1] for f in before.keys() - kept if "/days/" in f} == {"2026-09-04"}
    # The same run again, and a run without news.
    assert store.update(lines, night(12)) == [] and store.update(lines, night(13)) == []
    assert files(store.path) == after and stated(store) == want
    anew = series.DailySeries(spark, str(tmp_path / "anew"), DAY)
    anew.update(lines, night(13))
    assert stated(anew) == want
    key = lambda r: (r["block"], r["project_id"])
    assert sorted(map(tuple, anew.blocks().collect()), key=str) == sorted(map(tuple, store.blocks().collect()), key=str)
    assert {key(r) for r in anew.blocks().collect()}


def test_a_lost_run_is_repeated(spark, export, tmp_path, monkeypatch):
    store = series.DailySeries(spark, str(tmp_path / "series"), DAY)
    lines = export(*[day(n) for n in range(3)])
    monkeypatch.setattr(store, "_update_blocks", lambda days: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.update(lines, night(2))
    monkeypatch.undo()
    assert store.last_run() is None and len(store.update(lines, night(2))) == 3
    assert [x[3] for x in stated(store)] == [10.0] * 3 and store.blocks().count() > 0


def test_stream_then_restatement(spark, tmp_path, export):
    source, store = str(tmp_path / "in"), series.DailySeries(spark, str(tmp_path / "series"), DAY)
    add = lambda *rows: spark.createDataFrame(list(rows), schemas.BILLING_LINE).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(schemas.BILLING_LINE).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: jobs.finish(jobs.start_series(read(), store, str(tmp_path / "check")))
    add(day(0), day(1, project="p2"), day(2, cost="4"))
    run()
    add(day(10), day(0, arrives=2, cost="3"))
    run()
    add(day(1, arrives=12, cost="50"), day(20))
    run()
    closed = stated(store)
    assert closed == [(0, "p1", "Compute Engine", 13.0), (1, "p2", "Compute Engine", 10.0), (2, "p1", "Compute Engine", 4.0), (10, "p1", "Compute Engine", 10.0)]
    # The row twelve days late was dropped by the stream; a batch run picks it up.
    assert store.update(spark.read.schema(schemas.BILLING_LINE).parquet(source), night(13), since=night(12)) == [DAY + dt.timedelta(days=1)]
    assert stated(store) == sorted([*closed, (1, "p1", "Compute Engine", 50.0)])


def test_plan_reads_the_touched_days(spark, export):
    lines = export(*[day(n) for n in range(0, 60, 3)])
    days = [DAY + dt.timedelta(days=n) for n in (30, 31, 45)]
    text = plan(series.lines_of_days(lines, days, night(59)))
    assert all("2026-09-30" in f for f in re.findall(r"PartitionFilters: \[(.*?)\]\n", text))
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*?)\]\n", text))
    assert "2026-10-01" in pushed and "2026-10-03" in pushed and "2026-10-16" in pushed and "Or(" in pushed
    text = plan(series.changed_days(lines, night(50), night(51)))
    assert all("2026-10-20" in f for f in re.findall(r"PartitionFilters: \[(.*?)\]\n", text))
    schema = re.findall(r"ReadSchema: (.*)", text)[0]
    assert "cost:" not in schema and "labels" not in schema


def test_day_ranges():
    at = lambda *ns: [DAY + dt.timedelta(days=n) for n in ns]
    spans = lambda days, most=64: [((a - DAY).days, (b - DAY).days) for a, b in series.day_ranges(days, most)]
    assert spans(at(5, 3, 4, 9)) == [(3, 5), (9, 9)] and spans([]) == [] and spans(at(1, 3, 9, 30), 2) == [(1, 9), (30, 30)]
    assert spans(at(*range(0, 400, 2)), 3)[0][0] == 0 and len(spans(at(*range(0, 400, 2)), 3)) <= 3


def test_merged_moments_equal_the_window(spark, export, tmp_path):
    store = series.DailySeries(spark, str(tmp_path / "series"), DAY)
    rows = [day(n, cost=str(100 + 7 * n % 13), project=p) for n in range(40) for p in ("p1", "p2") if (p == "p1" or n % 3) and n != 20]
    rows += [day(38, cost="5000"), day(38, cost="900", project="new"), day(39, cost="1000", project="flat")] + [day(n, cost="8", project="flat") for n in range(38)]
    lines = export(*rows)
    store.update(lines, night(39))
    got = {r["project_id"]: r["moments"] for r in store.moments(DAY + dt.timedelta(days=4), DAY + dt.timedelta(days=33)).collect()}
    for p, found in got.items():
        cost = [sum(float(r["cost"]) for r in rows if r["project"]["id"] == p and r["ingest_date"] == DAY + dt.timedelta(days=n)) for n in range(4, 34)]
        assert found["n"] == 30 and found["mean"] == pytest.approx(statistics.mean(cost)) and found["m2"] == pytest.approx(statistics.variance(cost) * 29)
    assert set(got) == {"p1", "p2", "flat"} and got["flat"]["m2"] == 0
    for ago, flat in ((0, False), (1, False), (1, True), (-1, True)):
        as_of = DAY + dt.timedelta(days=40 - ago)
        want = anomalies.daily_anomalies(lines, as_of, flag_zero_variance=flat).collect()
        assert sorted(map(tuple, store.anomalies(as_of, flag_zero_variance=flat).collect())) == sorted(map(tuple, want))
        assert ago or want


def test_scoring_reads_blocks_and_single_days_only(spark, export, tmp_path):
    store = series.DailySeries(spark, str(tmp_path / "series"), DAY)
    store.update(export(*[day(n) for n in range(60)]), night(59))
    filters = re.findall(r"PartitionFilters: \[(.*?)\]\n", plan(store.anomalies(DAY + dt.timedelta(days=60))))
    dates = [f for f in filters if "usage_date" in f]
    blocks = [f for f in filters if "block" in f]
    # The day itself; at most ten single days and five blocks instead of thirty days.
    assert len(dates) == 2 and sum(len(re.findall(r"\d{4}-\d\d-\d\d", f)) for f in dates) <= 11
    assert len(blocks) == 1 and 4 <= len(re.findall(r"\b\d{4}\b", blocks[0])) <= 5, blocks


def test_successive_runs_read_the_landed_lines_only(spark, export, tmp_path):
    lines = export(*[day(n, cost="10") for n in range(-3, 12)], day(3, arrives=6, cost="5", credits=[("A", "-1")]), day(4, cost="7", cost_type="tax"), day(12, project="p2"))
    opened = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: opened.add(1) or x, "string")
    derived = lines.withColumn("cost_type", seen("cost_type").alias("cost_type"))
    anew, store = (series.DailySeries(spark, str(tmp_path / name), DAY) for name in ("anew", "store"))
    landed = store.landed(derived, str(tmp_path / "landed"), night(12))
    once = opened.value
    for n in (8, 9, 12):
        assert store.update(landed, night(n)) == anew.update(lines, night(n))
    # Three runs derive nothing again, and a run opens the newest partitions.
    assert 0 < once == opened.value
    assert stated(store) == stated(anew) and (3, "p1", "Compute Engine", 14.0) in stated(store)
    text = plan(series.changed_days(landed, night(9), night(12)))
    assert all("2026-09-09" in f for f in re.findall(r"PartitionFilters: \[(.*?)\]\n", text))


def test_the_registered_runs_derive_the_export_once(spark, monkeypatch):
    from outlay.catalog import series as catalog

    given, update = [], series.DailySeries.update
    monkeypatch.setattr(series.DailySeries, "update", lambda self, lines, *a: given.append(lines) or update(self, lines, *a))
    catalog.QUERIES["SNK3_incremental_anomalies"](spark, "/root/testdata/sf0.001")
    assert len(given) == 10 and not any("lineitem" in f for lines in given for f in lines.inputFiles())
