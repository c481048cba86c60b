"""Registered detectors reach every report; wrong ones are named."""

import pytest
from pyspark.sql import functions as F

from outlay.catalog import all_queries
from outlay.operators import detectors, inventory
from outlay.operators.findings import details_json, finding

SF = "/root/testdata/sf0.001"
BUILT_IN = ["unattached_disks", "idle_addresses", "stopped_instances", "old_snapshots", "empty_node_pools", "lbs_without_backends", "unused_sql"]


def big_disks(disks, context):
    """Disks above an option's size, at a flat price."""
    chosen = disks.filter(F.col("size_gb") >= context.option("big_disk_gb", 0))
    return finding(chosen, "big_disk", F.col("name"), F.lit("low"), F.lit(1.5), F.lit("Shrink it."), details_json(size=F.col("size_gb")))


def result(spark, name):
    return [tuple(r) for r in all_queries()[name](spark, SF).collect()]


def test_built_in_detectors():
    assert detectors.names() == BUILT_IN


def test_a_registered_detector_is_in_every_report(spark):
    reports = ("I8_all_findings", "I11_category_rollup", "I12_report_totals", "M1_run_summary", "SNK1_findings_sink")
    names = [n for n in all_queries() if n.split("_")[0] in {r.split("_")[0] for r in reports}]
    before = {n: result(spark, n) for n in names}
    with detectors.registered("big_disks", ("disks",), big_disks):
        after = {n: result(spark, n) for n in names}
    new = [r for n in names if n.startswith("I8") for r in after[n] if "big_disk" in r]
    old = [n for n in names if n.startswith("I8")][0]
    assert new and len(after[old]) == len(before[old]) + len(new)
    rollup = next(n for n in names if n.startswith("I11"))
    row = next(r for r in after[rollup] if r[0] == "big_disk")
    assert row[1:] == (len(new), 1.5 * len(new)) and not any(r[0] == "big_disk" for r in before[rollup])
    summary = next(n for n in names if n.startswith("M1"))
    count = lambda rows: next(r[2] for r in rows if r[:2] == ("idle_resources", "count"))
    assert count(after[summary]) == count(before[summary]) + len(new)
    assert detectors.names() == BUILT_IN and {n: sorted(map(str, result(spark, n))) for n in names} == {n: sorted(map(str, r)) for n, r in before.items()}


def test_options_reach_the_detector(spark, now):
    from outlay.binding import tables as b
    from outlay.catalog.inventory import P

    relations = b.inventory(spark, SF)
    with detectors.registered("big_disks", ("disks",), big_disks):
        found = lambda **kw: inventory.analyze(relations, P, now, **kw).filter("category = 'big_disk'").count()
        assert found() == relations["disks"].count() > found(big_disk_gb=500) and found(big_disk_gb=10**9) == 0


def test_wrong_detectors_are_named(spark, now):
    frame = spark.range(1)
    with detectors.registered("wrong", ("disks",), lambda disks, context: frame), pytest.raises(ValueError, match="detector wrong: columns differ"):
        detectors._REGISTRY["wrong"].findings({"disks": frame}, detectors.Context({}, now))
    with detectors.registered("lost", ("nowhere",), big_disks), pytest.raises(ValueError, match="detector lost: no relation nowhere"):
        detectors._REGISTRY["lost"].findings({"disks": frame}, detectors.Context({}, now))
    with pytest.raises(ValueError, match="registered already"):
        detectors.register("unused_sql", ())(big_disks)
