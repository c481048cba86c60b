"""Cross-detector summary as (section, metric, value, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.operators import findings as f
from outlay.operators import rightsizing, storage

ROW = "array<struct<section:string,metric:string,value:double,text:string>>"


def _rows(totals: DataFrame, section: str, values: dict[str, Column], texts: dict[str, Column] | None = None) -> DataFrame:
    """Unpivot a one-row relation."""
    entries = [
        F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
        for m, v in values.items()
    ] + [
        F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"), t.cast("string").alias("text"))
        for m, t in (texts or {}).items()
    ]
    return totals.select(F.inline(F.array(*entries).cast(ROW)))


def run_summary(
    idle: DataFrame, recs: DataFrame, warehouse_findings: DataFrame, breakeven: DataFrame, plans: DataFrame, cache_plans: DataFrame
) -> DataFrame:
    c = F.col
    return f.union_all(
        [
            _rows(
                idle.agg(F.count(F.lit(1)).alias("n"), f.cost_sum(~c("excluded")).alias("cost")),
                "idle_resources",
                {"count": c("n"), "monthly_estimate": c("cost")},
            ),
            _rows(
                rightsizing.summary(recs),
                "rightsizing",
                {"containers": c("containers"), "over": c("over"), "under": c("under")},
            ),
            _rows(warehouse_findings.agg(F.count(F.lit(1)).alias("n")), "bigquery", {"findings": c("n")}),
            _rows(breakeven, "bigquery", {}, {"slot_recommendation": c("recommendation")}),
            _rows(
                storage.total_saving(plans),
                "storage",
                {"buckets": c("buckets"), "monthly_saving_estimate": c("monthly_saving")},
            ),
            _rows(
                cache_plans.groupBy("recommended_policy").agg(F.sum("recommended_gb").alias("gb")),
                "redis",
                {},
                {"policy": F.concat("recommended_policy", F.lit(": "), "gb", F.lit(" GB"))},
            ),
        ]
    )
