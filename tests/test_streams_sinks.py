"""Streams equal the batch answer, late rows are dropped, alerts fire once; sinks are idempotent."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F
from test_billing import line

from outlay import schemas, sinks
from outlay.plans import budgets
from outlay.sources import documents
from outlay.streaming import jobs

DAY = dt.date(2026, 9, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Append batches of lines as files of one stream source."""
    src = str(tmp_path / "in")

    class Feed:
        def add(self, *rows):
            spark.createDataFrame(list(rows), schemas.BILLING_LINE).coalesce(1).write.mode("append").parquet(src)

        def stream(self):
            return spark.readStream.schema(schemas.BILLING_LINE).option("maxFilesPerTrigger", 1).parquet(src)

    return Feed()


def day(n, **kw):
    return line(day=DAY + dt.timedelta(days=n), **kw)


def test_rollup_drops_rows_later_than_the_watermark(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: jobs.finish(jobs.start_append(jobs.daily_rollup(feed.stream()), out, check))
    feed.add(day(0), day(1), day(2, credits=[("A", "-4")]))
    run()
    # Day 0 is still open for a row two days late.
    feed.add(day(0, cost="5"), day(10), day(9, cost_type="tax"))
    run()
    feed.add(day(1, cost="99"), day(20))
    run()
    got = {r["usage_date"].day: r["net_cost"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 15.0, 2: 10.0, 3: 6.0, 11: 10.0}


def test_spend_alerts(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    feed.add(day(0, cost="300"), day(0, cost="201", service="B"), day(0, cost="500", project="p2"), day(9))
    jobs.finish(jobs.start_alerts(jobs.spend_alerts(feed.stream()), out, str(tmp_path / "c")))
    assert [(r["project_id"], r["net_cost"]) for r in spark.read.parquet(out).collect()] == [("p1", 501.0)]


def test_spend_alerts_fire_once_and_at_once(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "c")
    run = lambda: jobs.finish(jobs.start_alerts(jobs.spend_alerts(feed.stream()), out, check))
    schema = "usage_date date, project_id string, net_cost double"
    fired = lambda: [(r["project_id"], r["net_cost"]) for r in spark.read.schema(schema).parquet(out).collect()]
    feed.add(day(0, cost="499"))
    run()
    assert fired() == []
    feed.add(day(0, cost="2"))
    run()
    assert fired() == [("p1", 501.0)]
    feed.add(day(0, cost="50"), day(1, cost="700", project="p2"))
    run()
    assert sorted(fired()) == [("p1", 501.0), ("p2", 700.0)]


def test_budget_alerts_fire_once(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: jobs.finish(jobs.start_budget_alerts(spark, feed.stream(), 1000.0, out, check))
    fired = lambda: sorted((r["basis"], r["threshold"]) for r in spark.read.parquet(out).collect())
    feed.add(day(14, cost="550"))
    run()
    # 550 by the 15th of 30 days is a forecast of 1100.
    assert fired() == [("actual", 0.5), ("forecast", 1.0)]
    feed.add(day(15, cost="300"))
    run()
    assert fired() == [("actual", 0.5), ("actual", 0.8), ("forecast", 1.0), ("forecast", 1.2)]
    feed.add(day(15, cost="1"))
    run()
    assert len(fired()) == 4


def test_budget_alerts_in_batch(spark):
    lines = spark.createDataFrame([day(14, cost="550")], schemas.BILLING_LINE)
    spend = budgets.month_to_date(lines, DAY + dt.timedelta(days=14))
    alerts = budgets.budget_alerts(spend, 1000.0)
    assert sorted((r["basis"], r["threshold"], r["forecast_cost"]) for r in alerts.collect()) == [("actual", 0.5, 1100.0), ("forecast", 1.0, 1100.0)]
    assert budgets.budget_alerts(spend, 1000.0, alerts.select("month", "project_id", "basis", "threshold")).count() == 0


def test_streamed_alignment_equals_batch(spark, tmp_path):
    from outlay.operators.metrics import align_reduce

    t0 = dt.datetime(2026, 9, 1)
    rows = [(f"s{i % 3}", f"g{i % 2}", t0 + dt.timedelta(minutes=7 * i), float(i)) for i in range(200)]
    points = spark.createDataFrame(rows, "series string, grp string, ts timestamp, value double")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    points.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(points.schema).parquet(src)
    jobs.finish(jobs.start_append(jobs.align_reduce_stream(stream, 3600, "mean", "sum", ["series"], ["grp"]), out, str(tmp_path / "c")))
    closed = max(r[2] for r in rows) - dt.timedelta(minutes=10)
    want = [tuple(r) for r in align_reduce(points, 3600, "mean", "sum", ["series"], ["grp"]).collect()]
    want = sorted(w for w in want if w[1] + dt.timedelta(hours=1) <= closed)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want


def test_sinks_replace_only_their_partition(spark, frame, tmp_path):
    path = str(tmp_path / "feed")
    schema = "usage_date date, project_id string, z double"
    sinks.append_anomalies(frame(schema, (DAY, "a", 1.0), (DAY, "b", 2.0)), path)
    next_day = DAY + dt.timedelta(days=1)
    for _ in range(2):
        sinks.append_anomalies(frame(schema, (next_day, "c", 3.0)), path)
    sinks.append_anomalies(frame(schema, (DAY, "a", 9.0)), path)
    got = sorted((r["usage_date"], r["project_id"], r["z"]) for r in spark.read.parquet(path).collect())
    assert got == [(DAY, "a", 9.0), (next_day, "c", 3.0)]


def test_findings_sink_orders_fields(spark, frame, tmp_path):
    path = str(tmp_path / "findings")
    sinks.write_findings(frame("b string, a string", ("x", "y")), path, DAY)
    text = spark.read.text(path + "/run_date=2026-09-01").first()[0]
    assert text == '{"a":"y","b":"x"}'


def test_shared_folder_uses_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = sinks.shared_folder(spark, "x")
    assert base is None or folder.startswith(base.rstrip("/") + "/outlay/x-")


def test_document_files(spark, tmp_path):
    (tmp_path / "inv.json").write_text(
        '{\n "as_of": "2026-09-21T02:00:00Z",\n "disks": [{"name": "d1", "size_gb": 5, "creation_timestamp": "2026-09-01T00:00:00Z"}, {"name": "d2", "users": ["v"]}],\n'
        ' "snapshots": []\n}'
    )
    inv = documents.load_inventory(spark, str(tmp_path / "inv.json"))
    assert sorted(r["name"] for r in inv["disks"].collect()) == ["d1", "d2"]
    assert inv["snapshots"].count() == inv["addresses"].count() == 0
    (tmp_path / "prices.json").write_text('{"currency": "USD", "gcs": {"standard_gb_month": 0.5}}')
    assert [tuple(r) for r in documents.load_prices(spark, str(tmp_path / "prices.json")).collect()] == [("gcs", "standard_gb_month", 0.5)]
    (tmp_path / "pools.conf").write_text("# c\n\np  c  l  general  2\n")
    assert [r["day_count"] for r in documents.load_pools(spark, str(tmp_path / "pools.conf")).collect()] == [2]


def test_alert_state_stays_bounded_over_many_batches(spark, feed, tmp_path, monkeypatch):
    from outlay.streaming import fired

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    asked = []
    of_periods = fired.FiredAlerts.of_periods

    def counted(self, session, periods, before=None):
        files = [f for p in periods for f in glob.glob(f"{self.path}/state/period={p}/**/*.parquet", recursive=True)]
        asked.append((sorted(periods), len(files)))
        return of_periods(self, session, periods, before)

    monkeypatch.setattr(fired.FiredAlerts, "of_periods", counted)
    # Twenty batches over five months; two projects pass their thresholds at different times.
    for i in range(20):
        feed.add(day(7 * i, cost="260"), day(7 * i, cost=str(40 + i), project="p2"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = jobs.start_budget_alerts(spark, feed.stream(), 1000.0, out, check)
        jobs.finish(query)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = spark.read.parquet(out).collect()
    keys = [(r["month"], r["project_id"], r["basis"], r["threshold"]) for r in rows]
    assert len(keys) == len(set(keys)) and len({k[0] for k in keys}) >= 5
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 20 and len(asked) >= 20
    # A batch reads one month, in two slots of one file, however many batches ran.
    assert max(len(p) for p, _ in asked) == 1 and max(n for _, n in asked) <= 2
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in batches]
    assert max(kept) <= 6 and kept[-1] <= 4
    state = spark.read.parquet(f"{out}-fired/state")
    assert state.groupBy("period", "slot").count().count() <= 2 * 6


@pytest.mark.parametrize("lost", ["out", "batch", "state"])
def test_lost_alert_batch_decides_as_before(spark, tmp_path, monkeypatch, lost):
    from outlay.streaming import fired

    schema = "usage_date date, project_id string, net_cost double"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    table = fired.FiredAlerts(str(tmp_path / "out"), frame().schema, ("usage_date", "project_id"), F.date_format("usage_date", "yyyyMM"))
    feed = lambda: sorted((r["project_id"], r["net_cost"], r["batch_id"]) for r in spark.read.parquet(table.feed).collect())
    table.write(frame((DAY, "a", 1.0)), 0)
    write = fired.overwrite_partitions

    def lose(df, path, *partitions):
        if path.endswith(lost):
            raise OSError("lost")
        write(df, path, *partitions)

    monkeypatch.setattr(fired, "overwrite_partitions", lose)
    second = frame((DAY, "a", 5.0), (DAY, "b", 2.0), (DAY + dt.timedelta(days=1), "a", 3.0))
    with pytest.raises(OSError):
        table.write(second, 1)
    monkeypatch.undo()
    for _ in range(2):
        table.write(second, 1)
    assert feed() == [("a", 1.0, 0), ("a", 3.0, 1), ("b", 2.0, 1)]
    table.write(frame(), 2)
    table.write(frame((DAY, "b", 9.0), (DAY, "c", 4.0)), 3)
    assert feed() == [("a", 1.0, 0), ("a", 3.0, 1), ("b", 2.0, 1), ("c", 4.0, 3)]


def test_closed_months_take_no_more_lines(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: jobs.finish(jobs.start_budget_alerts(spark, feed.stream(), 1000.0, out, check))
    feed.add(day(0, cost="100"))
    run()
    feed.add(day(35, cost="100"))
    run()
    # The month before is still open; the one before that is not.
    feed.add(day(20, cost="950"))
    run()
    feed.add(day(70, cost="1"))
    run()
    feed.add(day(10, cost="5000", project="late"))
    run()
    got = {(r["month"], r["project_id"]) for r in spark.read.parquet(out).collect()}
    assert ("202609", "p1") in got and ("202609", "late") not in got


def test_streamed_counter_rate_equals_batch(spark, tmp_path):
    from outlay.operators.metrics import counter_rate

    t0, src, out, check = dt.datetime(2026, 9, 1), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "metric string, pod string, ts timestamp, value double"
    at = lambda minute: t0 + dt.timedelta(minutes=minute)
    # Scrapes every two minutes, a reset in the second batch, a gap before the third, one series that ends early.
    batches = [
        [("cpu", p, at(m), 3.0 * m) for p in ("a", "b") for m in range(0, 30, 2)],
        [("cpu", "a", at(m), 3.0 * m if m < 40 else m - 39.0) for m in range(30, 60, 2)] + [("cpu", "a", at(28.5), 85.0)],
        [("cpu", "a", at(m), float(m)) for m in range(90, 121, 2)] + [("cpu", "b", at(300), 1.0), ("cpu", "b", at(301), None)],
        [("cpu", "c", at(400), 1.0), ("cpu", "a", at(3), 999.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.finish(jobs.start_append(jobs.counter_rate_stream(stream, ["pod"]), out, check))
    seen = [r for rows in batches for r in rows if r[3] is not None and r[3] != 999.0]
    points = spark.createDataFrame(seen, schema)
    closed = at(400) - dt.timedelta(minutes=10)
    want = [tuple(r) for r in counter_rate(points, ["pod"]).collect() if r["grid"] + dt.timedelta(minutes=5) <= closed]
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20
