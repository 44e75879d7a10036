"""Queries on corpus statistics and probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.iterate import settle
from ..operators import frequency as fr
from ..operators import probability as pr
from ..sources import corpus
from .registry import query
from .sqltext import query as sql


class World:
    """The corpus tables of one scale, made on demand.

    Counts, and the segments made of them, are written down when they are first asked for: everything
    but the pages is made of these tables, which Unicode bounds, so a query reads the texts once for
    all of them however often it names them. pairs: pairs of codepoints are wanted too, and one pass
    counts both.
    """

    def __init__(self, spark, sf_dir, pairs=False):
        self.spark, self.sf_dir = spark, sf_dir
        self.pages = corpus.pages(spark, sf_dir)
        if pairs:
            self.counts()

    def _once(self, name, make):
        if name not in self.__dict__:
            self.__dict__[name] = make()
        return self.__dict__[name]

    def font(self):
        return self._once("_font", lambda: corpus.number(self.single().select(F.col("cp1").alias("cp"))))

    def segments(self):
        return self._once("_segments", lambda: settle(corpus.segments(self.font())))

    def counts(self):
        return self._once("_counts", lambda: settle(fr.counts(self.pages)))

    def single(self):
        """(dataset, cp1, cp2, n) of single codepoints; their largest count is also that of all counts, as no pair has more pages than its parts."""
        return self._once("_single", lambda: self._counts.where("cp1 = cp2") if "_counts" in self.__dict__ else settle(fr.single_counts(self.pages)))

    def prob(self):
        return self._once("_prob", lambda: fr.probabilities(self.counts()))

    def conditions(self):
        return self._once("_conditions", lambda: corpus.conditions(self.segments()))

    def literals(self):
        return self._once("_literals", lambda: corpus.literals(self.conditions()))

    def seg_cp(self):
        """(dataset, segment_id, cp, p)."""

        def make():
            wanted = self.segments().select("segment_id", "cp").crossJoin(F.broadcast(self.single().select("dataset").distinct()))
            return settle(fr.single_probability(wanted, fr.probabilities(self.single()), fr.unknown(self.single())).select("dataset", "segment_id", "cp", "p"))

        return self._once("_seg_cp", make)

    def bounds(self):
        return self._once("_bounds", lambda: pr.pair_bounds(self.seg_cp(), self.prob()))

    def patch_glyphs(self):
        return corpus.patch_glyphs(self.segments(), self.conditions())


def r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


@query("f1_accumulate_counts", sql("SELECT dataset, least(cp1, cp2) AS cp1, greatest(cp1, cp2) AS cp2, sum(n)::BIGINT AS n FROM (SELECT * FROM counts UNION ALL SELECT dataset, cp2, cp1, n FROM counts) GROUP BY 1, 2, 3", "counts"))
def f1(spark, sf_dir):
    """Records given in both orders sum up by unordered pair."""
    c = World(spark, sf_dir).counts()
    return fr.accumulate(c.select("dataset", "cp1", "cp2", F.col("n").alias("count")).unionByName(c.select("dataset", F.col("cp2").alias("cp1"), F.col("cp1").alias("cp2"), F.col("n").alias("count"))), "dataset")


@query("f2_page_counts", sql("SELECT dataset, cp1, cp2, n FROM counts", "counts"))
def f2(spark, sf_dir):
    return World(spark, sf_dir).counts()


@query("f3_probabilities", sql("SELECT dataset, cp1, cp2, round(p, 9) AS p FROM prob", "prob"))
def f3(spark, sf_dir):
    return World(spark, sf_dir).prob().withColumn("p", r9("p"))


_WANTED = "SELECT dataset, unnest([65, 233, 8364, 128512]) AS cp FROM datasets"


@query("f4_single_probability", sql("SELECT w.dataset, w.cp, round(coalesce(u.p, b.unknown), 9) AS p FROM w JOIN best b USING (dataset) LEFT JOIN uni u ON u.dataset = w.dataset AND u.cp = w.cp", "uni", "best", "datasets", w=_WANTED))
def f4(spark, sf_dir):
    w = World(spark, sf_dir)
    wanted = fr.coverage(w.single()).select("dataset", F.explode(F.array(*map(F.lit, (65, 233, 8364, 128512)))).alias("cp"))
    return fr.single_probability(wanted, fr.probabilities(w.single()), fr.unknown(w.single())).select("dataset", "cp", r9("p").alias("p"))


@query("f5_pair_probability", sql("SELECT dataset, segment_id, a, b, round(pab, 9) AS pab FROM seg_pair", "seg_pair"))
def f5(spark, sf_dir):
    w = World(spark, sf_dir, pairs=True)
    s = w.seg_cp()
    x = s.select("dataset", "segment_id", F.col("cp").alias("a"), F.col("p").alias("pa"))
    y = s.select("dataset", "segment_id", F.col("cp").alias("b"), F.col("p").alias("pb"))
    return fr.pair_probability(x.join(y, ["dataset", "segment_id"]).where("a < b"), w.prob()).select("dataset", "segment_id", "a", "b", r9("pab").alias("pab"))


@query("f6_layout_tag_probability", "SELECT unnest(['liga', 'smcp']) AS tag, 0.001::DOUBLE AS p")
def f6(spark, sf_dir):
    return spark.createDataFrame([("liga",), ("smcp",)], "tag string").withColumn("p", F.lit(fr.LAYOUT_TAG))


@query("f7_covered_codepoints", sql("SELECT dataset, cp1 AS cp FROM counts WHERE cp1 = cp2", "counts"))
def f7(spark, sf_dir):
    return fr.coverage(World(spark, sf_dir).single()).select("dataset", F.explode("cps").alias("cp"))


@query("s7_dataset_coverage", sql("SELECT dataset, array_to_string(list_sort(list(cp1)), ',') AS cps FROM single GROUP BY dataset", "single"))
def s7(spark, sf_dir):
    return fr.coverage(World(spark, sf_dir).single()).select("dataset", F.concat_ws(",", F.transform("cps", lambda c: c.cast("string"))).alias("cps"))


@query("f8_unigram_segment", sql("SELECT dataset, segment_id, round(p, 9) AS p FROM seg_uni", "seg_uni"))
def f8(spark, sf_dir):
    return pr.any_of(World(spark, sf_dir).seg_cp(), "dataset", "segment_id").withColumn("p", r9("p"))


@query("f9_merged_unigram", sql("SELECT dataset, (segment_id // 2)::INT AS pair_id, round(1 - product(1 - (p_min + p_max) / 2), 9) AS p FROM seg_bound GROUP BY 1, 2", "seg_bound"))
def f9(spark, sf_dir):
    b = World(spark, sf_dir, pairs=True).bounds().select("dataset", F.floor(F.col("segment_id") / 2).cast("int").alias("pair_id"), pr.bound_average().alias("p"))
    return pr.any_of(b, "dataset", "pair_id").withColumn("p", r9("p"))


@query("f10_conjunctive_unigram", sql("SELECT dataset, (segment_id // 2)::INT AS pair_id, round(product((p_min + p_max) / 2), 9) AS p FROM seg_bound GROUP BY 1, 2", "seg_bound"))
def f10(spark, sf_dir):
    b = World(spark, sf_dir, pairs=True).bounds().select("dataset", F.floor(F.col("segment_id") / 2).cast("int").alias("pair_id"), pr.bound_average().alias("p"))
    return pr.all_of(b, "dataset", "pair_id").withColumn("p", r9("p"))


@query("f11_pair_bounds", sql("SELECT dataset, segment_id, round(p_min, 9) AS p_min, round(p_max, 9) AS p_max FROM seg_bound", "seg_bound"))
def f11(spark, sf_dir):
    return World(spark, sf_dir, pairs=True).bounds().withColumns({"p_min": r9("p_min"), "p_max": r9("p_max")})


@query("f12_bounds_with_tags", sql("SELECT dataset, segment_id, round(CASE WHEN segment_id % 3 > 0 THEN greatest(p_min, 0.001::DOUBLE) ELSE p_min END, 9) AS p_min, round(least(1.0::DOUBLE, p_max + least(1.0::DOUBLE, (segment_id % 3) * 0.001::DOUBLE)), 9) AS p_max FROM seg_bound", "seg_bound"))
def f12(spark, sf_dir):
    b = World(spark, sf_dir, pairs=True).bounds().withColumn("n_tags", F.col("segment_id") % 3)
    return pr.with_tags(b).drop("n_tags").withColumns({"p_min": r9("p_min"), "p_max": r9("p_max")})


_OR = """
    SELECT x.dataset, l.condition_id, x.cp AS cp, x.p FROM lit l JOIN seg_cp x USING (segment_id) WHERE l.condition_id BETWEEN 1000 AND 1999"""
_OR_PAIR = "SELECT x.dataset, x.condition_id, x.cp AS a, y.cp AS b, x.p AS pa, y.p AS pb, coalesce(q.p, x.p * y.p) AS pab FROM o x JOIN o y ON x.dataset = y.dataset AND x.condition_id = y.condition_id AND x.cp < y.cp LEFT JOIN prob q ON q.dataset = x.dataset AND q.cp1 = x.cp AND q.cp2 = y.cp"
_OR_STAR = "SELECT dataset, condition_id, max(t) AS star FROM (SELECT dataset, condition_id, j, sum(pab) AS t FROM (SELECT dataset, condition_id, a AS j, pab FROM op UNION ALL SELECT dataset, condition_id, b, pab FROM op) GROUP BY 1, 2, 3) GROUP BY 1, 2"
_OR_BOUND = """
    SELECT dataset, condition_id,
        CASE WHEN m1 >= 1 OR m2 >= 1 THEN 1.0::DOUBLE ELSE greatest(s1 - s2, m2, m1) END AS p_min,
        CASE WHEN m1 >= 1 OR m2 >= 1 THEN 1.0::DOUBLE ELSE greatest(least(s1 - star, 1.0::DOUBLE), s1 - s2, m2, m1) END AS p_max
    FROM (SELECT dataset, condition_id, sum(p) AS s1, max(p) AS m1 FROM o GROUP BY 1, 2)
    JOIN (SELECT dataset, condition_id, sum(pab) AS s2, max(pa + pb - pab) AS m2 FROM op GROUP BY 1, 2) USING (dataset, condition_id)
    JOIN os USING (dataset, condition_id)"""
_BEST = "SELECT dataset, condition_id, max(p_min) AS best FROM lit JOIN seg_bound USING (segment_id) WHERE condition_id BETWEEN 1000 AND 1999 GROUP BY 1, 2"
_MERGED = dict(o=_OR, op=_OR_PAIR, os=_OR_STAR, ob=_OR_BOUND, bb=_BEST)


@query("f13_merged_pair_bounds", sql("SELECT dataset, condition_id, round(greatest(p_min, best), 9) AS p_min, round(greatest(p_max, best), 9) AS p_max FROM ob JOIN bb USING (dataset, condition_id)", "lit", "seg_cp", "prob", "seg_bound", **_MERGED))
def f13(spark, sf_dir):
    """Two neighbouring segments merged: bounds of the union, at least the better one's."""
    w = World(spark, sf_dir, pairs=True)
    lits = w.literals().where("condition_id between 1000 and 1999")
    got = pr.condition_bounds(lits, w.seg_cp(), w.bounds(), w.prob())
    return got.select("dataset", "condition_id", r9("p_min").alias("p_min"), r9("p_max").alias("p_max"))


@query("f14_conjunctive_pair_bounds", sql("SELECT dataset, condition_id, round(greatest(0.0::DOUBLE, sum(p_min) - count(*) + 1), 9) AS p_min, round(least(1.0::DOUBLE, min(p_max)), 9) AS p_max FROM lit JOIN seg_bound USING (segment_id) WHERE condition_id >= 2000 GROUP BY 1, 2", "lit", "seg_bound"))
def f14(spark, sf_dir):
    w = World(spark, sf_dir, pairs=True)
    got = pr.conjunctive_bounds(w.literals().where("condition_id >= 2000").join(w.bounds(), "segment_id"), "dataset", "condition_id")
    return got.withColumns({"p_min": r9("p_min"), "p_max": r9("p_max")})


@query("f15_bound_average", sql("SELECT dataset, segment_id, round((p_min + p_max) / 2, 9) AS p FROM seg_bound", "seg_bound"))
def f15(spark, sf_dir):
    return World(spark, sf_dir, pairs=True).bounds().select("dataset", "segment_id", r9(pr.bound_average()).alias("p"))


_COND_P = "SELECT dataset, condition_id, product(g) AS p FROM (SELECT dataset, condition_id, group_no, 1 - product(1 - p) AS g FROM lit JOIN seg_uni USING (segment_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query("f16_condition_probability", sql("SELECT dataset, condition_id, round(p, 9) AS p FROM cp", "lit", "seg_uni", cp=_COND_P))
def f16(spark, sf_dir):
    w = World(spark, sf_dir)
    return pr.condition_probability(w.literals(), pr.any_of(w.seg_cp(), "dataset", "segment_id")).withColumn("p", r9("p"))


@query(
    "f17_merged_condition_probability",
    sql(
        "SELECT dataset, condition_id, round(product(g), 9) AS p FROM (SELECT dataset, condition_id, group_no, 1 - product(1 - p) AS g FROM lit JOIN o USING (segment_id) GROUP BY 1, 2, 3) GROUP BY 1, 2",
        "lit", "seg_uni",
        m="SELECT dataset, 1 - product(1 - p) AS p FROM seg_uni WHERE segment_id IN (0, 1) GROUP BY 1",
        o="SELECT u.dataset, u.segment_id, CASE WHEN u.segment_id = 0 THEN m.p ELSE u.p END AS p FROM seg_uni u JOIN m USING (dataset)",
    ),
)
def f17(spark, sf_dir):
    """Every condition's probability if segment 0 were replaced by the merge of segments 0 and 1."""
    w = World(spark, sf_dir)
    alone = pr.any_of(w.seg_cp(), "dataset", "segment_id")
    merged = pr.any_of(alone.where("segment_id in (0, 1)"), "dataset").withColumnsRenamed({"p": "merged"})
    changed = alone.join(merged, "dataset").select("dataset", "segment_id", F.when(F.col("segment_id") == 0, F.col("merged")).otherwise(F.col("p")).alias("p"))
    return pr.condition_probability(w.literals(), changed).withColumn("p", r9("p"))


@query("k6_frequency_listing", sql("SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY p DESC, cp) ::INT AS ord, format('0x{:04x}, {:.10f}', cp, p) AS line FROM uni", "uni"))
def k6(spark, sf_dir):
    return fr.listing(fr.probabilities(World(spark, sf_dir).single()))


@query("s5_union_of_shards", sql("SELECT cp1, cp2, sum(n)::BIGINT AS n FROM counts GROUP BY 1, 2", "counts"))
def s5(spark, sf_dir):
    """Datasets as shards of one, summed."""
    return World(spark, sf_dir).counts().groupBy("cp1", "cp2").agg(F.sum("n").alias("n"))


@query("s6_named_dataset", sql("SELECT cp1, cp2, round(p, 9) AS p FROM prob WHERE dataset = 'de'", "prob"))
def s6(spark, sf_dir):
    return World(spark, sf_dir).prob().where("dataset = 'de'").select("cp1", "cp2", r9("p").alias("p"))


@query("s11_codepoint_to_glyph", sql("SELECT cp, gid::INT AS gid FROM font", "font"))
def s11(spark, sf_dir):
    return World(spark, sf_dir).font()


@query("s13_font_codepoints", sql("SELECT cp FROM font UNION SELECT unnest([65024, 65039])", "font"))
def s13(spark, sf_dir):
    """Codepoints and variation selectors."""
    selectors = spark.createDataFrame([(0xFE00,), (0xFE0F,)], "cp int")
    return World(spark, sf_dir).font().select("cp").union(selectors).distinct()


_UVS = """
    SELECT f.cp AS base, v.sel, (10000 + f.gid)::INT AS gid FROM font f, (SELECT unnest([65024, 65039]) AS sel) v WHERE (f.cp + v.sel) % 7 = 0"""


def uvs(font, spark):
    """(base, sel, gid): sequences of a codepoint and a variation selector with a glyph of their own; every seventh by number."""
    sel = spark.createDataFrame([(0xFE00,), (0xFE0F,)], "sel int")
    return font.crossJoin(F.broadcast(sel)).where((F.col("cp") + F.col("sel")) % 7 == 0).select(F.col("cp").alias("base"), "sel", (10000 + F.col("gid")).alias("gid"))


@query("s12_variation_edges", sql("SELECT base AS src, sel AS other, gid FROM uvs UNION SELECT sel, base, gid FROM uvs", "font", uvs=_UVS))
def s12(spark, sf_dir):
    """An edge from either side, on condition of the other."""
    u = uvs(World(spark, sf_dir).font(), spark)
    return u.select(F.col("base").alias("src"), F.col("sel").alias("other"), "gid").union(u.select("sel", "base", "gid")).distinct()


@query("s14_glyph_to_codepoints", sql("SELECT gid, array_to_string(list_sort(list(DISTINCT cp)), ',') AS cps FROM (SELECT gid::INT AS gid, cp FROM font UNION ALL SELECT gid, base FROM uvs) GROUP BY gid", "font", uvs=_UVS))
def s14(spark, sf_dir):
    f = World(spark, sf_dir).font()
    both = f.select("gid", "cp").union(uvs(f, spark).select("gid", "base"))
    return both.groupBy("gid").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("cp")), lambda c: c.cast("string"))).alias("cps"))


@query("s15_glyphs_to_codepoints", sql("SELECT DISTINCT cp FROM font JOIN glyphs USING (gid) WHERE condition_id BETWEEN 2 AND 4", "font", "glyphs"))
def s15(spark, sf_dir):
    """Codepoints of the glyphs of patches 2 to 4."""
    w = World(spark, sf_dir)
    return w.font().join(w.patch_glyphs().where("condition_id between 2 and 4"), "gid", "left_semi").select("cp").distinct()


@query("s20_total_glyph_data", sql("SELECT condition_id, sum(40 + (gid * 37) % 200)::BIGINT AS nbytes FROM glyphs GROUP BY 1", "glyphs"))
def s20(spark, sf_dir):
    return World(spark, sf_dir).patch_glyphs().groupBy("condition_id").agg(F.sum(corpus.glyph_bytes(F.col("gid"))).alias("nbytes"))


@query("s19_glyph_data", sql("SELECT gid::INT AS gid, (40 + (gid * 37) % 200)::BIGINT AS nbytes FROM font", "font"))
def s19(spark, sf_dir):
    return World(spark, sf_dir).font().select("gid", corpus.glyph_bytes(F.col("gid")).alias("nbytes"))


@query("s22_indexed_slices", sql("SELECT gid::INT AS gid, (sum(40 + (gid * 37) % 200) OVER (ORDER BY gid) - (40 + (gid * 37) % 200))::BIGINT AS start_at, (sum(40 + (gid * 37) % 200) OVER (ORDER BY gid))::BIGINT AS end_at FROM font", "font"))
def s22(spark, sf_dir):
    """Offsets of glyphs' data in one stream: each ends where the next begins."""
    from pyspark.sql import Window as W

    w = W.orderBy("gid")
    return World(spark, sf_dir).font().select("gid", F.sum(corpus.glyph_bytes(F.col("gid"))).over(w).alias("end_at")).select("gid", (F.col("end_at") - corpus.glyph_bytes(F.col("gid"))).alias("start_at"), "end_at")


@query("s23_nominal_glyph", sql("SELECT w.cp, coalesce(gid, 0)::INT AS gid, gid IS NULL AS missing FROM (SELECT unnest([65, 233, 128512]) AS cp) w LEFT JOIN font USING (cp)", "font"))
def s23(spark, sf_dir):
    asked = spark.createDataFrame([(65,), (233,), (128512,)], "cp int")
    return asked.join(World(spark, sf_dir).font(), "cp", "left").select("cp", F.coalesce("gid", F.lit(0)).alias("gid"), F.col("gid").isNull().alias("missing"))
