"""Filling text templates from columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **parts: Column | int | str) -> Column:
    """Concatenate the literal pieces of ``template`` with the named columns or constants."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            part = parts[name]
            pieces.append(part.cast("string") if isinstance(part, Column) else F.lit(str(part)))
    return F.concat(*pieces)
