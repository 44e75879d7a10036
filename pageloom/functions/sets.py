"""Sets as arrays: sorted, distinct, without nulls. as_set() makes them; every function returns such an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(a)))


def span(lo: Column, hi: Column) -> Column:
    """All values from lo to hi; empty when hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.slice(F.sequence(lo, lo), 1, 0))


def insert(a: Column, *values: Column) -> Column:
    return as_set(F.concat(a, F.array(*values)))


def erase(a: Column, value) -> Column:
    return F.array_remove(a, value)


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def subtract(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return union(subtract(a, b), subtract(b, a))


def contains(a: Column, value) -> Column:
    return F.array_contains(a, value)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def intersects(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def lower_bound(a: Column, k) -> Column:
    """The smallest member >= k, or null."""
    return F.array_min(F.filter(a, lambda x: x >= k))


def before(a: Column, b: Column) -> Column:
    """The order of sets: by members, a prefix first. Arrays compare so by themselves."""
    return a < b


def text(a: Column) -> Column:
    """{1, 2}"""
    return F.concat(F.lit("{"), F.concat_ws(", ", F.transform(a, lambda x: x.cast("string"))), F.lit("}"))


def hex_text(a: Column) -> Column:
    """{0x41, 0x1f600}"""
    return F.concat(F.lit("{"), F.concat_ws(", ", F.transform(a, lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x))))), F.lit("}"))


def union_of(a: Column) -> Column:
    """Aggregate: the union of a group's sets."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(a))))


# Axis ranges: closed intervals as struct(start, end).


def axis_overlap(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def axis_intersection(a: Column, b: Column) -> Column:
    return F.when(axis_overlap(a, b), F.struct(F.greatest(a["start"], b["start"]).alias("start"), F.least(a["end"], b["end"]).alias("end")))


def axis_subtract(a: Column, b: Column) -> Column:
    """a less b: a where they are apart or b lies strictly inside a, null where b covers a, else what sticks out."""
    return (
        F.when(~axis_overlap(a, b), a)
        .when((b["start"] <= a["start"]) & (b["end"] >= a["end"]), F.lit(None))
        .when((a["start"] < b["start"]) & (a["end"] > b["end"]), a)
        .when(a["start"] < b["start"], F.struct(a["start"].alias("start"), b["start"].alias("end")))
        .otherwise(F.struct(b["end"].alias("start"), a["end"].alias("end")))
    )
