"""Scalar functions of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iequals(a: Column, b: Column) -> Column:
    """Equality that ignores case."""
    return F.lower(a) == F.lower(b)


def combine_sum(a: Column, b: Column) -> Column:
    return a + b


def combine_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def tuple_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def type_predicate(name: Column) -> Column:
    """The unary predicate that stands for a type."""
    return F.concat(F.lit("type@"), name)


def whole_seconds(limit: Column) -> Column:
    """A time limit in whole seconds, forgiving the last thousandth."""
    return F.floor(limit + 0.001).cast("int")
