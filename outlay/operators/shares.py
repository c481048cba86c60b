"""Totals and shares over already grouped rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.money import ratio, rounded


def share_within(df: DataFrame, value: str, groups: list[str], name: str, digits: int) -> DataFrame:
    """Percentage of ``value`` in the total of its group.

    The totals are aggregated and joined back, both over the shuffle that produced ``df``.  A window
    by group would bring all rows of a large group into one task; here the totals combine on the
    map side, and the join is broadcast by its measured size or split where a group is skewed.
    """
    own = [f"_{g}" for g in groups]
    totals = df.groupBy(*[F.col(g).alias(o) for g, o in zip(groups, own)]).agg(F.sum(value).alias("_total"))
    same = [F.col(g).eqNullSafe(F.col(o)) for g, o in zip(groups, own)]
    joined = df.join(totals, reduce(Column.__and__, same), "inner")
    return joined.withColumn(name, rounded(ratio(F.col(value), F.col("_total")) * 100, digits)).drop(*own, "_total")


def with_grand_total(grouped: DataFrame, sums: list[str]) -> DataFrame:
    """Attach the grand totals of ``sums`` as ``total_<name>``, one broadcast row.

    A window without a partition would send every group to one task.  The filter holds for any
    input with a group; it makes the total depend on every aggregate, so that the aggregation
    below it is the same as on the row side and its shuffle is computed once and reused.  Callers
    pass all aggregates of ``grouped``.
    """
    totals = grouped.agg(*[F.sum(c).alias(f"total_{c}") for c in sums]).filter(
        F.coalesce(*[F.col(f"total_{c}").cast("double") for c in sums]).isNotNull()
    )
    return grouped.crossJoin(F.broadcast(totals))


def share_of(value: Column, total: Column, digits: int) -> Column:
    return rounded(ratio(value, total) * 100, digits)
