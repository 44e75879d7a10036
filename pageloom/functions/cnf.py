"""Monotone conditions in conjunctive normal form: array<array<int>>, an AND of ORs over segments.

No groups is TRUE. canon() is the only maker of the canonical form: groups are sets, none is a
superset of another, sorted as sets are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import as_set

TYPE = "array<array<int>>"


def canon(groups: Column) -> Column:
    """Absorption: a group that holds another one adds nothing."""
    each = F.array_distinct(F.transform(groups, as_set))
    kept = F.filter(each, lambda g: ~F.exists(each, lambda h: (h != g) & (F.size(F.array_except(h, g)) == 0)))
    return F.array_sort(kept)


def conj(a: Column, b: Column) -> Column:
    return canon(F.concat(a, b))


def disj(a: Column, b: Column) -> Column:
    """(A1 AND A2) OR (B1 AND B2) = AND of all Ai OR Bj; TRUE if one side is."""
    return canon(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_union(x, y)))))


def touches(groups: Column, segments: Column) -> Column:
    return F.exists(groups, lambda g: F.arrays_overlap(g, segments))


def replace(groups: Column, base: Column, merged: Column) -> Column:
    """Every member of `merged` becomes `base`."""
    return canon(F.transform(groups, lambda g: F.transform(g, lambda s: F.when(F.array_contains(merged, s), base).otherwise(s))))


def without_touched(groups: Column, segments: Column) -> Column:
    """What is left once the segments are there: groups that overlap them are TRUE."""
    return F.filter(groups, lambda g: ~F.arrays_overlap(g, segments))


def pure_superset(groups: Column) -> Column:
    """A pure condition implied by the mixed one: its single-member groups if any, else the group whose smallest member is largest (of those the smaller one)."""
    singles = F.filter(groups, lambda g: F.size(g) == 1)
    ranked = F.array_sort(F.transform(groups, lambda g: F.struct((-F.array_min(g)).alias("m"), F.size(g).alias("n"), g.alias("g"))))
    return F.when(is_conjunctive(groups) | (F.size(groups) <= 1), groups).when(F.size(singles) > 0, singles).otherwise(F.array(ranked[0]["g"]))


def segments(groups: Column) -> Column:
    return as_set(F.flatten(groups))


def is_true(groups: Column) -> Column:
    return F.size(groups) == 0


def is_unitary(groups: Column) -> Column:
    return (F.size(groups) == 1) & F.forall(groups, lambda g: F.size(g) == 1)


def is_disjunctive(groups: Column) -> Column:
    return F.size(groups) == 1


def is_conjunctive(groups: Column) -> Column:
    return F.forall(groups, lambda g: F.size(g) == 1)


def least_group(groups: Column) -> Column:
    """Size of the smallest group; the largest unsigned int for TRUE."""
    return F.coalesce(F.array_min(F.transform(groups, F.size)).cast("long"), F.lit(4294967295).cast("long"))


def sort_key(groups: Column) -> Column:
    """Orders conditions: fewer groups first, then group by group smaller, then by members."""
    return F.struct(F.size(groups), F.transform(groups, lambda g: F.struct(F.size(g).alias("n"), g.alias("g"))))


def text(groups: Column, patch: Column) -> Column:
    """if ((s1 OR s2) AND s3) then p4"""

    def said(g):
        words = F.array_join(F.transform(g, lambda s: F.concat(F.lit("s"), s.cast("string"))), " OR ")
        return F.when(F.size(g) > 1, F.concat(F.lit("("), words, F.lit(")"))).otherwise(words)

    inner = F.array_join(F.transform(groups, said), " AND ")
    return F.concat(F.lit("if ("), F.when(F.size(groups) == 0, F.lit("true")).otherwise(inner), F.lit(") then p"), patch.cast("string"))
