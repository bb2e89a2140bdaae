"""Predicates of conditional writes and of routing, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(op: Column, left: Column, right: Column) -> Column:
    """eq, lt, lte, gt or gte of two values; any other operator is false."""
    return (
        F.when(op == "eq", left == right)
        .when(op == "lt", left < right)
        .when(op == "lte", left <= right)
        .when(op == "gt", left > right)
        .when(op == "gte", left >= right)
        .otherwise(F.lit(False))
    )


def holds(found: Column, version: Column, updated_at: Column, want_exists: Column, version_op: Column, want_version: Column, time_op: Column, want_time: Column) -> Column:
    """Whether an object meets a write's conditions; a null condition asks nothing, an absent object fails version and time."""
    exists = want_exists.isNull() | (want_exists == found)
    by_version = version_op.isNull() | (found & F.coalesce(compare(version_op, version, want_version), F.lit(False)))
    by_time = time_op.isNull() | (found & F.coalesce(compare(time_op, updated_at, want_time), F.lit(False)))
    return exists & by_version & by_time


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds, in order; null if none does."""
    return reduce(lambda c, x: c.when(F.coalesce(x[0], F.lit(False)), x[1]), checks[1:], F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1]))
