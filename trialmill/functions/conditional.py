"""Conditionals and recodes that keep a missing condition missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP = "keep"


def case_when(*pairs: tuple[Column, object], default: object = None) -> Column:
    """First matching condition wins; a missing condition never matches."""
    (condition, value), *rest = pairs
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def if_null_safe(condition: Column, then: object, other: object) -> Column:
    """Two-way choice that is missing where the condition is missing."""
    return F.when(condition, then).when(~condition, other)


def recode(col: Column, mapping: Mapping, default: object = None) -> Column:
    """Value map. Unmatched values become NULL, stay (`KEEP`) or take the default."""
    pairs = [(col == F.lit(old), F.lit(new)) for old, new in mapping.items()]
    if default == KEEP:
        return case_when(*pairs, default=col)
    return case_when(*pairs, default=None if default is None else F.lit(default))


def null_if(col: Column, *values: object) -> Column:
    """NULL for each of the given placeholder values."""
    return F.when(~col.isin(*values), col)


def clamp(col: Column, low: object, high: object) -> Column:
    """Restrict to [low, high]; a missing value or bound leaves the comparison unmet."""
    return F.when(col < low, low).when(col > high, high).otherwise(col)
