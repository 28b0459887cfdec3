"""Two-valued comparisons, conditions and orders of the query language, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """An absent condition is false."""
    return F.coalesce(c, F.lit(False))


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    """Absent differs from any value."""
    return ~a.eqNullSafe(b)


def lt(a: Column, b: Column) -> Column:
    return truthy(a < b)


def le(a: Column, b: Column) -> Column:
    return truthy(a <= b)


def gt(a: Column, b: Column) -> Column:
    return truthy(a > b)


def ge(a: Column, b: Column) -> Column:
    return truthy(a >= b)


def negate(c: Column) -> Column:
    return ~truthy(c)


def ordered(*keys: Column | str, identity: str) -> list:
    """Every order ends with the identity, so that limits are deterministic."""
    return [*keys, F.col(identity)]
