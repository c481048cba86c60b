import datetime as dt

from pyspark.sql import functions as F

from outlay.operators.metrics import counter_rate
from outlay.streaming import jobs


def test_rates_of_many_series_share_the_groups_of_the_state(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    minute = F.col("id") % 40
    points = spark.range(56_000).select(
        F.lit("cpu").alias("metric"),
        F.when(F.col("id") >= 40, F.concat(F.lit("p"), (F.col("id") / 40).cast("int"))).alias("pod"),
        F.timestamp_seconds(F.lit(1788220800) + minute * 150 + F.when(minute > 20, 3600).otherwise(0)).alias("ts"),
        (F.col("id") * 37 % 101).cast("double").alias("value"),
    )
    points.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(points.schema).parquet(src)
    query = jobs.start_append(jobs.counter_rate_stream(stream, ["pod"]), out, check)
    jobs.finish(query)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= jobs.COUNTER_GROUPS
    assert spark.read.parquet(src).select("pod").distinct().count() == 1400
    last = points.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = [tuple(r) for r in counter_rate(points, ["pod"]).collect() if r["grid"] + dt.timedelta(minutes=5) <= last]
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    shown = lambda rows: sorted((str(r[1]), r[2], round(r[3], 9)) for r in rows)
    assert shown(got) == shown(want) and len(got) > 2000
