"""Row predicates with explicit reference times. All are null-tolerant Column expressions that push down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def live(status: Column) -> Column:
    """Superseded and merged rows stay; a null status is a legacy row that is alive."""
    return F.coalesce(~status.isin("expired", "archived"), F.lit(True))


def flag(c: Column, default: bool) -> Column:
    return F.coalesce(c, F.lit(default))


def in_scope(scope: Column, wanted) -> Column:
    return scope.isNull() | (scope == wanted)


def not_before(c: Column, at) -> Column:
    return c.isNull() | (c <= at)


def not_after(c: Column, at) -> Column:
    return c.isNull() | (c > at)


def valid_at(start: Column, created: Column, end: Column, superseded: Column, at) -> Column:
    """Half-open validity; a row without a start isn't valid."""
    begin = F.coalesce(start, created)
    return F.coalesce((begin <= at) & not_after(end, at) & not_after(superseded, at), F.lit(False))


def overlaps(start: Column, end: Column, low, high) -> Column:
    """Half-open overlap with [low, high); a degenerate interval overlaps nothing. Nulls are unbounded."""
    real = start.isNull() | end.isNull() | (start < end)
    return real & (start.isNull() | (start < high)) & (end.isNull() | (end > low))


def known_at(valid_from: Column, valid_to: Column, recorded_from: Column, recorded_to: Column, valid, recorded) -> Column:
    """Bi-temporal as-of: true in the world at `valid`, as recorded at `recorded`."""
    return (valid_from <= valid) & not_after(valid_to, valid) & (recorded_from <= recorded) & not_after(recorded_to, recorded)


def both(*predicates: Column | None) -> Column:
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))
