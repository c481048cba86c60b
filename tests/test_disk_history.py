"""Idle days of disks: validity intervals of versions against a day-by-day recount."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from test_billing import AS_OF, line, lines  # noqa: F401

from outlay import schemas
from outlay.operators import billing, disk_history

NAME = "//compute.googleapis.com/projects/p/zones/z/disks/"
USED, FREE = '{"users":["vm"]}', '{"users":[],"labels":{"keep":"true"}}'


@pytest.fixture
def assets(spark):
    def make(*rows):
        return spark.createDataFrame([(NAME + n, t, {"data": doc}) for n, t, doc in rows], schemas.ASSET)

    return make


def at(day, hour=0):
    return dt.datetime(2026, 9, day, hour)


def test_attached_and_detached_twice(lines, assets):  # noqa: F811
    history = [("d", at(1), USED), ("d", at(5, 9), FREE), ("d", at(10, 9), USED), ("d", at(14, 9), FREE), ("d", at(14, 11), FREE)]
    bill = lines(*[line(day=dt.date(2026, 9, d), cost=str(d), sku="Storage PD Capacity", gname=NAME + "d") for d in range(1, 21)])
    row = disk_history.idle_disk_cost(bill, assets(*history), AS_OF).collect()[0]
    idle = [6, 7, 8, 9, *range(15, 21)]
    assert (row.idle_days_billed, row.idle_cost_30d, row.net_cost_30d) == (len(idle), float(sum(idle)), 210.0)
    assert row.idle_since == dt.date(2026, 9, 15)
    runs = disk_history.idle_intervals(assets(*history), AS_OF).collect()
    assert sorted((r.idle_from.day, r.idle_to.day) for r in runs) == [(6, 10), (15, 22)]


def test_edges_of_a_history(lines, assets):  # noqa: F811
    runs = lambda *rows: sorted((r.idle_from, r.idle_to, r.idle_since) for r in disk_history.idle_intervals(assets(*rows), AS_OF).collect())
    end = AS_OF + dt.timedelta(days=1)
    day = lambda d: dt.date(2026, 9, d)
    assert runs() == [] and runs(("d", at(3), USED)) == []
    # Created idle: that day counts. Attached for an hour: that day does not.
    assert runs(("d", at(3), FREE)) == [(day(3), end, day(3))]
    assert runs(("d", at(3), FREE), ("d", at(8, 1), USED), ("d", at(8, 2), FREE)) == [(day(3), day(8), day(9)), (day(9), end, day(9))]
    # Detached on the last day, changed after it, or without a time.
    assert runs(("d", at(3), USED), ("d", at(21, 5), FREE)) == []
    assert runs(("d", at(3), FREE), ("d", at(22), USED), ("d", None, USED)) == [(day(3), end, day(3))]
    # Repeated versions and documents without users or text.
    assert runs(("d", at(3), "{}"), ("d", at(3), "{}"), ("d", at(4), None)) == [(day(3), end, day(3))]


def test_random_histories_match_a_daily_recount(lines, assets):  # noqa: F811
    rnd = random.Random(5)
    history = sorted({(f"d{rnd.randrange(6)}", at(rnd.randrange(1, 24), rnd.randrange(24))): rnd.choice([USED, FREE]) for _ in range(120)}.items())
    costs = [(f"d{i}", dt.date(2026, 9, d), rnd.randrange(1, 50)) for i in range(7) for d in range(1, 22)]
    bill = lines(*[line(day=d, cost=str(c), sku="Hyperdisk", gname=NAME + n) for n, d, c in costs])
    got = {r.net_cost_30d: (r.idle_cost_30d, r.idle_days_billed) for r in disk_history.idle_disk_cost(bill, assets(*[(n, t, x) for (n, t), x in history]), AS_OF).collect()}
    want = {}
    for disk in sorted({n for n, _, _ in costs}):
        idle = []
        for name, day, cost in costs:
            before = [x for (n, t), x in history if n == disk and t.date() < day]
            during = [x for (n, t), x in history if n == disk and t.date() == day]
            if name == disk and (before or during) and USED not in before[-1:] + during:
                idle.append(cost)
        if idle:
            want[float(sum(c for n, _, c in costs if n == disk))] = (float(sum(idle)), len(idle))
    assert got == want and len(want) >= 4


def test_equal_update_times_give_one_state_whatever_the_order(assets):
    rows = [("d", at(3), USED), ("d", at(3), FREE), ("d", None, USED), ("e", None, FREE)]
    states = lambda x: sorted(map(tuple, billing.disk_states(assets(*x)).collect()), key=str)
    assert states(rows) == states(rows[::-1]) and len(states(rows)) == 2


def test_documents_stay_in_the_scan(lines, assets):  # noqa: F811
    free = assets(("d", at(3), FREE))
    bill = lines(line(sku="Storage PD Capacity", gname=NAME + "d", cost=Decimal("1")))
    for df in (billing.unattached_disk_cost(bill, free, AS_OF), billing.disk_states(free), disk_history.idle_disk_cost(bill, free, AS_OF)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and "Cartesian" not in text and "NestedLoop" not in text
        assert not [x for x in text.splitlines() if "Exchange" in x and "data#" in x]
