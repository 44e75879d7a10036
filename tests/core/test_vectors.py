"""Known answers, worked by hand, for the probability and condition operators."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import cnf, codec
from pageloom.operators import frequency as fr
from pageloom.operators import graph as gr
from pageloom.operators import patches as pt
from pageloom.operators import probability as pr


def counts(spark, pairs):
    rows = [("x", a, b, n) for (a, b), n in pairs.items()]
    return fr.accumulate(spark.createDataFrame(rows, "dataset string, cp1 int, cp2 int, count long"), "dataset")


def test_probabilities(spark):
    c = counts(spark, {(1, 2): 10, (3, 2): 20, (1, 1): 5})
    got = {(r.cp1, r.cp2): r.p for r in fr.probabilities(c).collect()}
    assert got == {(1, 2): 0.5, (2, 3): 1.0, (1, 1): 0.25}


def test_counts_add_up_in_either_order(spark):
    rows = [("x", 2, 3, 20), ("x", 1, 2, 10), ("x", 2, 1, 15)]
    c = fr.accumulate(spark.createDataFrame(rows, "dataset string, cp1 int, cp2 int, count long"), "dataset")
    got = {(r.cp1, r.cp2): r.p for r in fr.probabilities(c).collect()}
    assert got == {(1, 2): 1.0, (2, 3): 0.8}


def test_what_is_unknown(spark):
    c = counts(spark, {(1, 2): 10, (2, 3): 20, (3, 3): 15})
    wanted = spark.createDataFrame([("x", 1), ("x", 3), ("y", 1)], "dataset string, cp int")
    got = {(r.dataset, r.cp): r.p for r in fr.single_probability(wanted, fr.probabilities(c), fr.unknown(c)).collect()}
    assert got == {("x", 1): 1 / 20, ("x", 3): 15 / 20, ("y", 1): 0.0}


def test_any_of(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 1.0), (2, 0.5), (2, 0.25)], "k int, p double")
    assert {r.k: r.p for r in pr.any_of(rows, "k").collect()} == {1: 1.0, 2: 0.625}


def test_pair_bounds(spark):
    prob = spark.createDataFrame([("x", 1, 1, 0.7), ("x", 2, 2, 0.6), ("x", 1, 2, 0.4)], "dataset string, cp1 int, cp2 int, p double")
    seg = spark.createDataFrame([("x", 0, 1, 0.7), ("x", 0, 2, 0.6)], "dataset string, segment_id int, cp int, p double")
    r = pr.pair_bounds(seg, prob).first()
    assert round(r.p_min, 9) == 0.9 and round(r.p_max, 9) == 0.9


def canon(spark, groups):
    return spark.createDataFrame([(groups,)], f"g {cnf.TYPE}").select(cnf.canon(F.col("g")).alias("g")).first().g


def test_absorption(spark):
    assert canon(spark, [[1, 2], [1]]) == [[1]]
    assert canon(spark, [[3], [2, 1], [1, 2, 3], [2, 1]]) == [[1, 2], [3]]
    assert canon(spark, []) == []


def test_and_or_against_truth_tables(spark):
    rng = random.Random(1)
    make = lambda: [rng.sample(range(5), rng.randint(1, 3)) for _ in range(rng.randint(0, 3))]
    pairs = [(i, make(), make()) for i in range(40)]
    df = spark.createDataFrame(pairs, f"i int, a {cnf.TYPE}, b {cnf.TYPE}")
    got = df.select("i", "a", "b", cnf.conj(F.col("a"), F.col("b")).alias("both"), cnf.disj(F.col("a"), F.col("b")).alias("either")).collect()
    holds = lambda groups, on: all(any(s in on for s in g) for g in groups)
    for r in got:
        for bits in range(32):
            on = {s for s in range(5) if bits >> s & 1}
            assert holds(r.both, on) == (holds(r.a, on) and holds(r.b, on))
            assert holds(r.either, on) == (holds(r.a, on) or holds(r.b, on))


def test_or_pulls_out_shared_groups(spark):
    df = spark.createDataFrame([([[1, 2], [3], [4]], [[1, 2], [3], [5]])], f"a {cnf.TYPE}, b {cnf.TYPE}")
    e = cnf.disj(F.col("a"), F.col("b"))
    assert df.select(cnf.text(e, F.lit(10)).alias("t")).first().t == "if ((s1 OR s2) AND s3 AND (s4 OR s5)) then p10"


@pytest.mark.parametrize("branch", codec.BRANCHES)
def test_sparse_bit_sets(branch):
    rng = random.Random(42)
    for _ in range(150):
        values = {rng.randrange(2048) for _ in range(rng.randrange(1200))}
        data = codec.encode_set(values, branch if values else None)
        assert codec.decode_set(data) == (sorted(values), len(data))
    assert codec.decode_set(codec.encode_set(range(branch**3), branch)) == (list(range(branch**3)), 2 + (branch == 32) * 3)


def test_patch_urls():
    head = bytes([10]) + b"//foo.bar/"
    assert codec.patch_url(head, 5) == "//foo.bar/"
    assert codec.patch_url(head + bytes([128]), 0) == "//foo.bar/00"
    assert codec.patch_url(head + bytes([128]), 123) == "//foo.bar/FC"
    assert codec.patch_url(head + bytes([129, 1, 47, 130, 1, 47, 128]), 478) == "//foo.bar/0/F/07F0"
    assert codec.patch_url(head + bytes([129, 1, 47, 130, 1, 47, 131, 1, 47, 128]), 123) == "//foo.bar/C/F/_/FC"
    assert codec.patch_url(head + bytes([133]), 14000000) == "//foo.bar/1Z-A"
    assert codec.patch_url(head + bytes([133]), 0) == "//foo.bar/AA%3D%3D"
    for bad in (head + bytes([134]), bytes([0]) + head, bytes([11]) + b"//foo.bar/"):
        with pytest.raises(ValueError):
            codec.patch_url(bad, 0)


def test_numbers():
    assert codec.read_axis_segment(codec.axis_segment("wght", 100, 900.5)) == ("wght", 100.0, 900.5)
    assert codec.entry_deltas(0, [1]) == b"\0\0\0" and codec.entry_deltas(0, [3, 2]) == bytes([0, 0, 5]) + (-4).to_bytes(3, "big", signed=True)


def test_closure_waits_for_all_groups(spark):
    edges = spark.createDataFrame([(1, 0, "B"), (2, 0, "C"), (3, 0, "D")], "edge_id int, phase int, dst string")
    needs = spark.createDataFrame([(1, 0, "A"), (2, 0, "A"), (2, 1, "X"), (3, 0, "B"), (3, 1, "B"), (3, 1, "Y")], "edge_id int, group_no int, node string")
    start = spark.createDataFrame([(0, "A"), (1, "A"), (1, "X")], "request int, node string")
    got = {}
    for r in gr.closure(start, edges, needs).collect():
        got.setdefault(r.request, set()).add(r.node)
    assert got == {0: {"A", "B", "D"}, 1: {"A", "X", "B", "C", "D"}}


def test_levels_and_cycles(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert {r.node: r.level for r in pt.levels(arcs).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        pt.levels(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def test_strong_components(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {r.node: r.root for r in gr.strong_components(arcs).collect()} == {"a": "a", "b": "a", "c": "c"}
