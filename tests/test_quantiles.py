"""Stored daily sketches: exact while small, within the rank error beyond, replaced by day."""

import datetime as dt
import math
import random
import re

import pytest
from test_physical_plans import plan

from outlay.operators import quantiles

DAY = dt.date(2026, 9, 1)
POINTS = "metric string, pod string, grid timestamp, value double"


def points(spark, rows):
    """(pod, day number, value) rows, spread over their day."""
    moment = lambda n, i: dt.datetime.combine(DAY + dt.timedelta(days=n), dt.time(i % 24, i % 60))
    return spark.createDataFrame([("mem", p, moment(n, i), v) for i, (p, n, v) in enumerate(rows)], POINTS)


@pytest.fixture
def store(spark, tmp_path):
    return quantiles.QuantileStore(spark, str(tmp_path / "sketches"), ["pod"], k=200)


def at(n):
    return DAY + dt.timedelta(days=n)


def test_small_series_are_exact_and_large_ones_within_the_error(spark, store):
    rnd = random.Random(3)
    rows = [("small", rnd.randrange(10), float(rnd.randrange(50))) for _ in range(150)]
    # A hot series with nearly all points, half of them one value.
    rows += [("hot", rnd.randrange(10), rnd.choice([7.0, rnd.gauss(0, 100)])) for _ in range(20_000)]
    rows += [("hot", 0, None), ("hot", 1, math.nan), ("none", 1, None)]
    given = points(spark, rows).repartition(6)
    store.write_days(given, at(0), at(9))
    found = {r["pod"]: r for r in store.quantiles(at(0), at(9), p50=0.5, p95=0.95, p99=0.99).collect()}
    for pod in ("small", "hot"):
        values = sorted(v for p, _, v in rows if p == pod and v is not None and not math.isnan(v))
        r = found[pod]
        assert (r["n"], r["highest"]) == (len(values), values[-1])
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            if pod == "small":
                assert r[name] == values[math.ceil(q * len(values)) - 1]
            low, high = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
            slack = 3 * quantiles.rank_error(200)
            assert low <= (q + slack) * len(values) and high >= (q - slack) * len(values)
    checked = quantiles.within_rank_error(given.where("value is not null and not isnan(value)"), store.quantiles(at(0), at(9), p95=0.95), store.series, 0.95, "p95", 3 * quantiles.rank_error(200))
    assert {r["pod"]: r["within"] for r in checked.collect()} == {"small": True, "hot": True}


def test_a_day_stated_again_replaces_itself(spark, store):
    rows = [("a", n, float(10 * n + i)) for n in range(4) for i in range(5)]
    store.write_days(points(spark, rows), at(0), at(3))
    late = [*rows, ("a", 2, 500.0), ("b", 2, 1.0)]
    for _ in range(2):
        store.write_days(points(spark, late), at(2), at(2))
    got = {r["pod"]: (r["n"], r["highest"], r["p50"]) for r in store.quantiles(at(0), at(3), p50=0.5).collect()}
    values = sorted(v for p, _, v in late if p == "a")
    assert got == {"a": (21, 500.0, values[10]), "b": (1, 1.0, 1.0)}
    assert {r["n"] for r in store.quantiles(at(0), at(1), p50=0.5).collect()} == {10}


def test_lookback_reads_the_sketches_of_its_days_only(spark, store):
    assert store.quantiles(at(0), at(3), p50=0.5).count() == 0
    store.write_days(points(spark, [("a", n, 1.0) for n in range(30)]), at(0), at(29))
    text = plan(store.quantiles(at(16), at(29), p95=0.95))
    filters = re.findall(r"PartitionFilters: \[(.*?)\]\n", text)
    assert len(filters) == 1 and "2026-09-17" in filters[0] and "2026-09-30" in filters[0]
    assert "grid" not in re.findall(r"ReadSchema: (.*)", text)[0]
