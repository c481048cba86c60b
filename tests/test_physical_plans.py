"""Shape of the physical plans."""

import datetime as dt
import re

import pytest
from test_billing import line

from outlay import schemas
from outlay.catalog import all_queries as queries
from outlay.functions.labels import has_label
from outlay.functions.money import MONEY
from outlay.operators import billing

SF = "/root/testdata/sf0.001"
AS_OF = dt.date(2026, 9, 21)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("export"))
    cluster = [{"key": "goog-k8s-cluster-name", "value": "c"}]
    rows = [line(day=AS_OF - dt.timedelta(days=d), sku="Egress", unit="gibibyte", labels=cluster) for d in range(0, 200, 10)]
    spark.createDataFrame(rows, schemas.BILLING_LINE).write.partitionBy("ingest_date").mode("overwrite").parquet(path)
    return spark.read.schema(schemas.BILLING_LINE).parquet(path)


def test_partition_and_column_pruning(export):
    text = plan(billing.cost_by_service(export, AS_OF))
    filters = re.findall(r"PartitionFilters: \[(.*?)\]\n", text)
    assert filters and all("ingest_date" in f and "2026-07-20" in f for f in filters)
    assert any("GreaterThanOrEqual(usage_start_time" in f for f in re.findall(r"PushedFilters: \[(.*?)\]\n", text))
    schema = re.findall(r"ReadSchema: (.*)", text)[0]
    assert "service" in schema and "labels" not in schema and "resource" not in schema
    # Of the credits only the amounts are read.
    assert "credits:array<struct<amount:decimal(28,10)>>" in schema
    for run in (billing.credits_breakdown, billing.commitment_coverage):
        assert f"credits:array<struct<type:string,amount:{MONEY}>>" in plan(run(export, AS_OF))
    assert "labels:array<struct<key:string>>" in plan(lines_with_key(export))


def lines_with_key(lines):
    return lines.filter(has_label(lines["labels"], "x")).select("cost")


def test_totals_reuse_the_shuffle(export):
    for run in (billing.cost_by_service, billing.egress_cost, billing.cost_by_label, billing.cost_by_namespace):
        df = run(export, AS_OF)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in text.split("== Initial Plan ==")[0]


# Built eagerly: sinks and streams run jobs of their own.
EAGER = ("S1_", "S2_", "S3_budget_alerts_stream", "S4_", "SNK", "T_rate_stream", "T_nrp_sketches")


@pytest.mark.parametrize("name", [n for n in sorted(queries()) if not n.startswith(EAGER)])
def test_no_python_and_no_single_task_window(spark, name):
    text = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct"):
        assert bad not in text
    lines = text.splitlines()
    for i, current in enumerate(lines):
        if "Exchange SinglePartition" in current:
            # Only final aggregates and top-n may gather, never a window.
            assert not any("Window" in above for above in lines[max(0, i - 3) : i]), current
    # The only nested-loop join is the one with a one-row total.
    if "BroadcastNestedLoopJoin" in text:
        assert name.split("_")[0] in ("B1", "B7", "P13"), name


def test_view_between_days_prunes(export):
    text = plan(billing.cost_between(export, "20260801", "20260803"))
    assert all("2026-07-31" in f for f in re.findall(r"PartitionFilters: \[(.*?)\]\n", text))
    assert "GreaterThanOrEqual(usage_start_time" in text and "LessThan(usage_start_time" in text


def test_back_fill_bounds_its_partitions(export):
    from outlay.operators import anomalies

    since, baseline_days, clock_days = dt.date(2026, 9, 1), 30, 4
    text = plan(anomalies.daily_anomalies(export, AS_OF, baseline_days=baseline_days, score_since=since))
    filters = re.findall(r"PartitionFilters: \[(.*?)\]\n", text)
    earliest = since - dt.timedelta(days=baseline_days + 1 + clock_days)
    assert filters and all(f">= {earliest}" in f for f in filters)


def test_every_scan_of_the_query_log_is_bounded(spark):
    text = plan(queries()["Q1_query_rollup"](spark, SF))
    assert text.count("isnotnull(job_id)") == 0 or "creation_time" in text


def test_panels_read_their_time_range(spark, export, tmp_path):
    from outlay.operators import dashboards, metrics

    schema = "metric string, cluster string, namespace string, pod string, container string, node string, ts timestamp, value double"
    path = str(tmp_path / "samples")
    spark.createDataFrame([], schema).write.parquet(path)
    samples, now = spark.read.schema(schema).parquet(path), dt.datetime(2026, 9, 21, 2)
    panels = [metrics.cluster_totals(samples, r, now=now) for r in ("cpu", "memory")]
    panels.append(metrics.label_values(samples, "namespace", now=now, cluster="main"))
    for panel in panels:
        pushed = re.findall(r"PushedFilters: \[(.*?)\]\n", plan(panel))
        assert pushed and all("GreaterThanOrEqual(ts,2026-09-20" in f and "LessThan(ts,2026-09-21" in f for f in pushed), pushed
    text = plan(dashboards.arrival_lag(export, as_of=AS_OF, window_days=30))
    assert all("2026-08-22" in f and "2026-09-21" in f for f in re.findall(r"PartitionFilters: \[(.*?)\]\n", text))
