"""Lookups in repeated key/value labels and in label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_value(labels: Column, key: str) -> Column:
    """Value of the first entry with this key; NULL when there is none.

    A position lookup compiles, which a filter over the array does not.
    """
    return F.get(labels["value"], F.array_position(labels["key"], F.lit(key)).cast("int") - 1)


def has_label(labels: Column, key: str) -> Column:
    """Whether any entry has this key; reads only the keys."""
    return F.coalesce(F.array_contains(labels["key"], F.lit(key)), F.lit(False))


def map_label(labels: Column, key: str) -> Column:
    return F.try_element_at(labels, F.lit(key))


def is_kept(labels: Column) -> Column:
    """keep=true in any letter case marks a resource as excluded."""
    return F.coalesce(F.lower(map_label(labels, "keep")) == "true", F.lit(False))


def no_users(users: Column) -> Column:
    return F.coalesce(F.size(users), F.lit(0)) <= 0
