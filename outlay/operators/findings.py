"""The shared findings relation: construction, order, split, rollup, totals and delta.

A finding has the columns of ``schemas.FINDING_COLUMNS``.  Any function that returns such a
DataFrame can be added to the union of checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.money import rounded

SEVERITIES = ("high", "medium", "low")


def details_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def finding(
    df: DataFrame,
    category: str | Column,
    resource: Column,
    severity: Column,
    monthly: Column,
    recommendation: Column,
    details: Column,
    excluded: Column | None = None,
) -> DataFrame:
    return df.select(
        (F.lit(category) if isinstance(category, str) else category).alias("category"),
        resource.alias("resource"),
        severity.alias("severity"),
        rounded(monthly).alias("monthly_cost_estimate"),
        recommendation.alias("recommendation"),
        (F.lit(False) if excluded is None else excluded).alias("excluded"),
        details.alias("details"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == "high", 0)
    for i, name in enumerate(SEVERITIES[1:], start=1):
        rank = rank.when(severity == name, i)
    return rank.otherwise(9)


def sort_findings(findings: DataFrame) -> DataFrame:
    """Severity, then cost from the top, then resource; a range-partitioned sort."""
    return findings.orderBy(
        severity_rank(F.col("severity")), F.col("monthly_cost_estimate").desc(), F.col("resource")
    )


def split_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actionable findings and those excluded by label."""
    return findings.filter(~F.col("excluded")), findings.filter("excluded")


def cost_sum(cond: Column | None = None) -> Column:
    """Sum of the estimates as exact cents."""
    cents = F.col("monthly_cost_estimate").cast("decimal(18,2)")
    if cond is not None:
        cents = F.when(cond, cents).otherwise(F.lit(0).cast("decimal(18,2)"))
    return F.coalesce(F.sum(cents), F.lit(0).cast("decimal(28,2)")).cast("double")


def category_rollup(findings: DataFrame) -> DataFrame:
    actionable, _ = split_findings(findings)
    return actionable.groupBy("category").agg(
        F.count(F.lit(1)).alias("findings"), cost_sum().alias("monthly_cost_estimate")
    )


def report_totals(findings: DataFrame) -> DataFrame:
    """Report figures: the run-rate counts actionable findings, the JSON total counts all."""
    return findings.agg(
        F.count_if(~F.col("excluded")).alias("actionable"),
        F.count_if("excluded").alias("excluded"),
        cost_sum(~F.col("excluded")).alias("actionable_run_rate"),
        cost_sum().alias("total_monthly_estimate"),
    )


def findings_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New, resolved and changed findings between two runs."""
    keys = ["category", "resource"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("monthly_cost_estimate").alias(name))

    joined = side(previous, "previous_cost").join(side(current, "current_cost"), keys, "full_outer")
    before, after = F.col("previous_cost"), F.col("current_cost")
    return joined.select(
        *keys,
        before,
        after,
        rounded(F.coalesce(after, F.lit(0.0)) - F.coalesce(before, F.lit(0.0))).alias("cost_delta"),
        F.when(before.isNull(), "new")
        .when(after.isNull(), "resolved")
        .when(before != after, "changed")
        .otherwise("unchanged")
        .alias("change"),
    )
