"""Queries on sets, axis ranges and conditions, over the corpus's own sets.

Sets: for each ordered pair of datasets, a is all codepoints of the first and b the codepoints on
at least half of the second's pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cnf
from ..functions import sets as st
from .registry import query
from .sqltext import query as sql
from .statistics import World

_SETS = """
    SELECT x.dataset AS da, y.dataset AS db, x.a, y.b FROM (SELECT dataset, list_sort(list(cp1)) AS a FROM single GROUP BY dataset) x
    JOIN (SELECT s.dataset, list_sort(list(cp1)) AS b FROM single s JOIN (SELECT dataset, count(*) AS pages FROM pages GROUP BY dataset) n USING (dataset) WHERE 2 * s.n >= n.pages GROUP BY s.dataset) y ON x.dataset <> y.dataset"""


def pairs(spark, sf_dir):
    """(da, db, a, b)."""
    w = World(spark, sf_dir)
    single = w.single()
    n = w.pages.groupBy("dataset").agg(F.count("*").alias("pages"))
    a = single.groupBy("dataset").agg(F.array_sort(F.collect_list("cp1")).alias("a")).withColumnRenamed("dataset", "da")
    b = single.join(n, "dataset").where(2 * F.col("n") >= F.col("pages")).groupBy("dataset").agg(F.array_sort(F.collect_list("cp1")).alias("b")).withColumnRenamed("dataset", "db")
    return a.join(b, F.col("da") != F.col("db"))


def _list(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


#: name -> (Spark column over a and b, SQL over a and b); arrays come out as text
_OPS = {
    "a1_insert": (lambda a, b: _list(st.insert(a, F.lit(7), F.lit(70000))), "array_to_string(list_sort(list_distinct(list_concat(a, [7, 70000]))), ',')"),
    "a1_insert_range": (lambda a, b: _list(st.union(a, st.span(F.lit(200), F.lit(220)))), "array_to_string(list_sort(list_distinct(list_concat(a, range(200, 221)))), ',')"),
    "a2_contains": (lambda a, b: st.contains(a, 233), "list_contains(a, 233)"),
    "a3_is_subset": (lambda a, b: st.is_subset(b, a), "len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0"),
    "a4_intersects": (lambda a, b: st.intersects(a, b), "list_has_any(a, b)"),
    "a5_min_max": (lambda a, b: F.concat_ws("-", F.array_min(a).cast("string"), F.array_max(b).cast("string")), "list_min(a) || '-' || list_max(b)"),
    "a6_erase_size": (lambda a, b: F.size(st.erase(a, 101)), "len(list_filter(a, lambda x: x <> 101))::INT"),
    "a7_union": (lambda a, b: _list(st.union(a, b)), "array_to_string(list_sort(list_distinct(list_concat(a, b))), ',')"),
    "a8_intersect": (lambda a, b: _list(st.intersect(a, b)), "array_to_string(list_sort(list_intersect(a, b)), ',')"),
    "a9_subtract": (lambda a, b: _list(st.subtract(a, b)), "array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',')"),
    "a10_symmetric_difference": (lambda a, b: _list(st.symmetric_difference(a, b)), "array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ',')"),
    "a11_complement_within": (lambda a, b: _list(st.subtract(st.span(F.lit(32), F.lit(126)), a)), "array_to_string(list_filter(range(32, 127), lambda x: NOT list_contains(a, x)), ',')"),
    "a12_lower_bound": (lambda a, b: st.lower_bound(a, 90), "list_min(list_filter(a, lambda x: x >= 90))"),
    "a13_before": (lambda a, b: st.before(a, b), "a < b"),
    "a14_to_string": (lambda a, b: F.concat(st.text(b), st.hex_text(b)), "'{' || array_to_string(b, ', ') || '}' || '{' || array_to_string(list_transform(b, lambda x: '0x' || lower(format('{:x}', x))), ', ') || '}'"),
}



def _register(name, column, text):
    @query(name, sql(f"SELECT da, db, {text} AS value FROM sets", "single", "pages", sets=_SETS))
    def run(spark, sf_dir, column=column):
        return pairs(spark, sf_dir).select("da", "db", column(F.col("a"), F.col("b")).alias("value"))


for _name, (_column, _text) in _OPS.items():
    _register(_name, _column, _text)


@query("a7_union_aggregate", sql("SELECT array_to_string(list_sort(list(DISTINCT cp)), ',') AS cps, count(DISTINCT page)::BIGINT AS n FROM page_cp", "page_cp"))
def a7_union_aggregate(spark, sf_dir):
    p = World(spark, sf_dir).pages
    conj = p.groupBy("dataset").agg(st.union_of(F.col("cps")).alias("cps"), F.count(F.when(F.size("cps") > 0, 1)).alias("n"))
    return conj.agg(_list(st.union_of(F.col("cps"))).alias("cps"), F.sum("n").alias("n"))


# Axis ranges: dataset x's range is [its smallest, its largest] letter probability in percent, so overlaps of all kinds occur.

_AXES = """
    SELECT x.dataset AS da, y.dataset AS db, x.lo AS a0, x.hi AS a1, y.lo AS b0, y.hi AS b1 FROM ax x JOIN ax y ON x.dataset <> y.dataset"""
_AX = "SELECT dataset, min(cp)::DOUBLE AS lo, (count(*) * 3 % 140)::DOUBLE + 40 AS hi FROM (SELECT DISTINCT dataset, cp FROM page_cp WHERE cp > 32) GROUP BY dataset"


def _axes(spark, sf_dir):
    w = World(spark, sf_dir)
    each = w.single().select("dataset", F.col("cp1").alias("cp")).where("cp > 32")
    ax = each.groupBy("dataset").agg(F.min("cp").cast("double").alias("lo"), ((F.count("*") * 3 % 140).cast("double") + 40).alias("hi"))
    a = ax.select(F.col("dataset").alias("da"), F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")).alias("a"))
    b = ax.select(F.col("dataset").alias("db"), F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")).alias("b"))
    return a.join(b, F.col("da") != F.col("db"))


@query("a15_axis_ranges", sql("SELECT da, db, a0 <= b1 AND b0 <= a1 AS overlap, CASE WHEN a0 <= b1 AND b0 <= a1 THEN greatest(a0, b0) END AS lo, CASE WHEN a0 <= b1 AND b0 <= a1 THEN least(a1, b1) END AS hi FROM axes", "page_cp", ax=_AX, axes=_AXES))
def a15(spark, sf_dir):
    conj = st.axis_intersection(F.col("a"), F.col("b"))
    return _axes(spark, sf_dir).select("da", "db", st.axis_overlap(F.col("a"), F.col("b")).alias("overlap"), conj["start"].alias("lo"), conj["end"].alias("hi"))


_SUBTRACTED = """
    SELECT da, db,
        CASE WHEN NOT (a0 <= b1 AND b0 <= a1) THEN a0 WHEN b0 <= a0 AND b1 >= a1 THEN NULL WHEN a0 < b0 THEN a0 ELSE b1 END AS lo,
        CASE WHEN NOT (a0 <= b1 AND b0 <= a1) THEN a1 WHEN b0 <= a0 AND b1 >= a1 THEN NULL WHEN a0 < b0 AND a1 > b1 THEN a1 WHEN a0 < b0 THEN b0 ELSE a1 END AS hi FROM axes"""


@query("a16_axis_subtract", sql(_SUBTRACTED, "page_cp", ax=_AX, axes=_AXES))
def a16(spark, sf_dir):
    left = st.axis_subtract(F.col("a"), F.col("b"))
    return _axes(spark, sf_dir).select("da", "db", left["start"].alias("lo"), left["end"].alias("hi"))


@query("a17_design_space_subtract", sql("SELECT da, count(*) FILTER (WHERE lo IS NULL)::BIGINT AS gone, count(lo)::BIGINT AS left_over FROM sub GROUP BY da", "page_cp", ax=_AX, axes=_AXES, sub=_SUBTRACTED))
def a17(spark, sf_dir):
    """A space of one axis for each other dataset: axes that the subtraction removes, and those it leaves."""
    left = _axes(spark, sf_dir).select("da", st.axis_subtract(F.col("a"), F.col("b")).alias("x"))
    return left.groupBy("da").agg(F.count(F.when(F.col("x").isNull(), 1)).alias("gone"), F.count("x").alias("left_over"))


@query("a18_definition_union", sql("SELECT db, min(a0) AS lo, max(a1) AS hi FROM axes GROUP BY db", "page_cp", ax=_AX, axes=_AXES))
def a18(spark, sf_dir):
    """Union of definitions: of an axis's ranges the covering one."""
    return _axes(spark, sf_dir).groupBy("db").agg(F.min("a.start").alias("lo"), F.max("a.end").alias("hi"))


@query("a19_definition_subtract", sql(f"SELECT s.da, s.db, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS n, lo, hi FROM sets s JOIN sub u ON s.da = u.da AND s.db = u.db", "single", "pages", "page_cp", sets=_SETS, ax=_AX, axes=_AXES, sub=_SUBTRACTED))
def a19(spark, sf_dir):
    left = a16(spark, sf_dir)
    return pairs(spark, sf_dir).join(left, ["da", "db"]).select("da", "db", F.size(st.subtract(F.col("a"), F.col("b"))).alias("n"), "lo", "hi")


@query("a20_definition_equal", sql("SELECT da, db, a = b AS same, len(b) = 0 AS void FROM sets", "single", "pages", sets=_SETS))
def a20(spark, sf_dir):
    return pairs(spark, sf_dir).select("da", "db", (F.col("a") == F.col("b")).alias("same"), (F.size("b") == 0).alias("void"))


@query("a21_is_variable", sql("SELECT da, bool_or(hi > lo) AS variable FROM sub GROUP BY da", "page_cp", ax=_AX, axes=_AXES, sub=_SUBTRACTED))
def a21(spark, sf_dir):
    return a16(spark, sf_dir).groupBy("da").agg(F.bool_or(F.col("hi") > F.col("lo")).alias("variable"))


@query("a22_definition_entries", sql("SELECT da, db, unnest([0, 1, 2]) AS entry, unnest(['codepoints', 'axis', 'conj']) AS kind, unnest([len(b)::INT, 1, 2]) AS n, unnest([true, true, false]) AS ignored FROM sets", "single", "pages", sets=_SETS))
def a22(spark, sf_dir):
    """A definition of two kinds of members becomes one entry a kind, ignored, and one that is either of them."""
    one = F.array(
        F.struct(F.lit(0).alias("entry"), F.lit("codepoints").alias("kind"), F.size("b").alias("n"), F.lit(True).alias("ignored")),
        F.struct(F.lit(1).alias("entry"), F.lit("axis").alias("kind"), F.lit(1).alias("n"), F.lit(True).alias("ignored")),
        F.struct(F.lit(2).alias("entry"), F.lit("conj").alias("kind"), F.lit(2).alias("n"), F.lit(False).alias("ignored")),
    )
    return pairs(spark, sf_dir).select("da", "db", F.explode(one).alias("e")).select("da", "db", "e.*")


@query("a24_minimum_group_size", sql("SELECT segment_id, count(*) >= 6 AS meets FROM seg GROUP BY 1", "seg"))
def a24(spark, sf_dir):
    return World(spark, sf_dir).segments().groupBy("segment_id").agg((F.count("*") >= 6).alias("meets"))


@query("a26_disjoint_codepoints", sql("SELECT cp1 AS cp, count(*)::BIGINT AS n FROM single GROUP BY 1 HAVING count(*) > 1", "single"))
def a26(spark, sf_dir):
    """Codepoints in more than one dataset, were datasets segments."""
    return World(spark, sf_dir).single().groupBy(F.col("cp1").alias("cp")).agg(F.count("*").alias("n")).where("n > 1")


@query("a27_segments_disjoint", sql("SELECT count(*)::BIGINT AS clashes FROM (SELECT cp FROM seg GROUP BY cp HAVING count(*) > 1 UNION ALL SELECT cp FROM seg WHERE cp <= 32)", "seg"))
def a27(spark, sf_dir):
    s = World(spark, sf_dir).segments()
    twice = s.groupBy("cp").agg(F.count("*").alias("n")).where("n > 1").select("cp")
    return twice.unionByName(s.where("cp <= 32").select("cp")).agg(F.count("*").alias("clashes"))


@query("a28_segments_for_codepoints", sql("SELECT page, array_to_string(list_sort(list(segment_id)), ',') AS segments FROM page_seg GROUP BY page", "page_seg"))
def a28(spark, sf_dir):
    from ..operators.sizes import page_segments

    w = World(spark, sf_dir)
    return page_segments(w.pages, w.segments()).groupBy("page").agg(_list(F.array_sort(F.collect_list("segment_id"))).alias("segments"))


@query("a29_derived_sets", sql("SELECT (SELECT count(DISTINCT segment_id) FROM seg)::BIGINT AS non_empty, (SELECT count(*) FROM seg)::BIGINT AS non_init_glyphs, (SELECT count(*) FROM font WHERE cp <= 32)::BIGINT AS init_codepoints", "seg"))
def a29(spark, sf_dir):
    w = World(spark, sf_dir)
    init = w.font().where("cp <= 32").agg(F.count("*").alias("init_codepoints"))
    return w.segments().agg(F.countDistinct("segment_id").alias("non_empty"), F.count("*").alias("non_init_glyphs")).crossJoin(F.broadcast(init))


# Conditions: the corpus's conditions paired by their first segment's distance, so that CNFs of several shapes meet.

_PAIRED = """
    SELECT x.condition_id AS ca, y.condition_id AS cb, x.groups AS a, y.groups AS b FROM cond x JOIN cond y ON x.condition_id < y.condition_id AND abs(x.condition_id % 1000 - y.condition_id % 1000) <= 2"""


def _canon(e):
    """SQL of the canonical form of a list of lists."""
    each = f"list_distinct(list_transform({e}, lambda g: list_sort(list_distinct(g))))"
    return f"list_sort(list_filter({each}, lambda g: len(list_filter({each}, lambda h: h <> g AND len(list_filter(h, lambda s: NOT list_contains(g, s))) = 0)) = 0))"


def _said(e):
    return f"array_to_string(list_transform({e}, lambda g: array_to_string(g, '|')), '&')"


def _groups(c):
    return F.concat_ws("&", F.transform(c, lambda g: F.concat_ws("|", F.transform(g, lambda s: s.cast("string")))))


def condition_pairs(spark, sf_dir):
    c = World(spark, sf_dir).conditions()
    x = c.select(F.col("condition_id").alias("ca"), F.col("groups").alias("a"), (F.col("condition_id") % 1000).alias("ka"))
    y = c.select(F.col("condition_id").alias("cb"), F.col("groups").alias("b"), (F.col("condition_id") % 1000).alias("kb"))
    # Neighbours by number meet through an equality, a band join in five steps.
    x = x.withColumn("k", F.explode(F.sequence(F.col("ka") - 2, F.col("ka") + 2)))
    return x.join(y, F.col("k") == F.col("kb")).where("ca < cb").select("ca", "cb", "a", "b")


_AND, _OR = "list_concat(a, b)", "flatten(list_transform(a, lambda x: list_transform(b, lambda y: list_concat(x, y))))"
_MIXED = f"SELECT ca, cb, {_canon(_AND)} AS conj, {_canon(_OR)} AS either FROM paired"


def _pairs_cnf(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return condition_pairs(spark, sf_dir).select("ca", "cb", cnf.conj(a, b).alias("conj"), cnf.disj(a, b).alias("either"))


_HAS = "len(list_filter(g, lambda s: list_contains([0, 2, 4], s))) > 0"
_SWAP = "list_transform(conj, lambda g: list_transform(g, lambda s: CASE WHEN list_contains([1, 3], s) THEN 1 ELSE s END))"
_CNF = {
    "c2_simplify": (lambda: _groups(cnf.canon(F.concat("conj", "either"))), _said(_canon("list_concat(conj, either)"))),
    "c3_and": (lambda: _groups(F.col("conj")), _said("conj")),
    "c4_or": (lambda: _groups(F.col("either")), _said("either")),
    "c5_intersects": (lambda: cnf.touches(F.col("conj"), F.array(*map(F.lit, (0, 2, 4)))), f"len(list_filter(conj, lambda g: {_HAS})) > 0"),
    "c6_replace_segments": (lambda: _groups(cnf.replace(F.col("conj"), F.lit(1), F.array(F.lit(1), F.lit(3)))), _said(_canon(_SWAP))),
    "c7_remove_intersecting": (lambda: _groups(cnf.without_touched(F.col("conj"), F.array(*map(F.lit, (0, 2, 4))))), _said(f"list_filter(conj, lambda g: NOT ({_HAS}))")),
    "c8_pure_superset": (
        lambda: _groups(cnf.pure_superset(F.col("conj"))),
        _said("CASE WHEN len(conj) <= 1 OR len(list_filter(conj, lambda g: len(g) <> 1)) = 0 THEN conj WHEN len(list_filter(conj, lambda g: len(g) = 1)) > 0 THEN list_filter(conj, lambda g: len(g) = 1) ELSE [list_sort(list_transform(conj, lambda g: {'m': -list_min(g), 'n': len(g), 'g': g}))[1].g] END"),
    ),
    "c9_triggering_segments": (lambda: _list(cnf.segments(F.col("conj"))), "array_to_string(list_sort(list_distinct(flatten(conj))), ',')"),
    "c10_predicates": (
        lambda: F.concat_ws(",", cnf.is_true(F.col("either")).cast("string"), cnf.is_unitary(F.col("either")).cast("string"), cnf.is_disjunctive(F.col("either")).cast("string"), cnf.is_conjunctive(F.col("either")).cast("string")),
        "(len(either) = 0)::VARCHAR || ',' || (len(either) = 1 AND len(list_filter(either, lambda g: len(g) <> 1)) = 0)::VARCHAR || ',' || (len(either) = 1)::VARCHAR || ',' || (len(list_filter(either, lambda g: len(g) <> 1)) = 0)::VARCHAR",
    ),
    "c11_least_group": (lambda: cnf.least_group(F.col("either")), "coalesce(list_min(list_transform(either, lambda g: len(g))), 4294967295)::BIGINT"),
    "c13_equal": (lambda: F.col("conj") == F.col("either"), "conj = either"),
    "k5_condition_text": (
        lambda: cnf.text(F.col("conj"), F.col("ca")),
        "'if (' || CASE WHEN len(conj) = 0 THEN 'true' ELSE array_to_string(list_transform(conj, lambda g: CASE WHEN len(g) > 1 THEN '(' || array_to_string(list_transform(g, lambda s: 's' || s), ' OR ') || ')' ELSE 's' || g[1] END), ' AND ') END || ') then p' || ca",
    ),
}


def _register_cnf(name, make, text):
    @query(name, sql(f"SELECT ca, cb, {text} AS value FROM mixed", "cond", paired=_PAIRED, mixed=_MIXED))
    def run(spark, sf_dir, make=make):
        return _pairs_cnf(spark, sf_dir).select("ca", "cb", make().alias("value"))


for _name, (_make, _text) in _CNF.items():
    _register_cnf(_name, _make, _text)


@query(
    "c12_condition_order",
    sql("SELECT condition_id, row_number() OVER (ORDER BY len(groups), list_transform(groups, lambda g: {'n': len(g), 'g': g}), condition_id)::INT AS ord FROM cond", "cond"),
)
def c12(spark, sf_dir):
    from pyspark.sql import Window as W

    return World(spark, sf_dir).conditions().select("condition_id", F.row_number().over(W.orderBy(cnf.sort_key(F.col("groups")), "condition_id")).alias("ord"))


@query("c1_constructors", "SELECT unnest(['true', 'one', 'and', 'or', 'composite']) AS kind, unnest(['', '5', '1&2', '1|2', '1|2&3']) AS value")
def c1(spark, sf_dir):
    made = [("true", []), ("one", [[5]]), ("and", [[2], [1]]), ("or", [[2, 1]]), ("composite", [[3], [1, 2], [1, 2, 4]])]
    return spark.createDataFrame(made, f"kind string, groups {cnf.TYPE}").select("kind", _groups(cnf.canon(F.col("groups"))).alias("value"))


@query("c15_plan_round_trip", sql(f"SELECT condition_id, {_said('groups')} AS value FROM cond", "cond"))
def c15(spark, sf_dir):
    """Conditions to JSON and back."""
    text = F.to_json("groups")
    return World(spark, sf_dir).conditions().select("condition_id", _groups(F.from_json(text, cnf.TYPE)).alias("value"))
