import importlib

import pytest
from pyspark.sql import functions as F

BOUNDED = """m5_best_case m7_cost_deltas m8_inert_threshold m12_apply_merge m13_init_moves o14_best_candidate m5_best_case_by_dataset m7_cost_deltas_by_dataset
    m8_inert_threshold_by_dataset m12_apply_merge_by_dataset m13_init_moves_by_dataset o14_best_candidate_by_dataset o7_segment_order o8_pregroup_segments o10_segment_cutoff
    f10_conjunctive_unigram f12_bounds_with_tags f13_merged_pair_bounds f27_cost_report"""


def rows_read(spark):
    store = spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30_000)
    stages = store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name,most", [*((n, 1) for n in BOUNDED.split()), ("f24_page_cost", 3)])
def test_texts_are_read_once(spark, sf_dir, name, most):
    """Counts are made in one pass; f24 also reads the pages for what each loads, and to number them."""
    e = importlib.import_module("__spark_entry__")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    before = rows_read(spark)
    e.queries()[name](spark, sf_dir).collect()
    assert rows_read(spark) - before <= most * docs


def test_one_pass_counts_singles_and_pairs(spark):
    from pageloom.operators import frequency as fr

    pages = spark.createDataFrame([(1, "a", [1, 2, 3]), (2, "a", [2, 3]), (3, "a", []), (4, "a", None), (5, "b", [7]), (6, None, [1, 2])], "page int, dataset string, cps array<int>")
    want = {("a", 1, 1): 1, ("a", 2, 2): 2, ("a", 3, 3): 2, ("a", 1, 2): 1, ("a", 1, 3): 1, ("a", 2, 3): 2, ("b", 7, 7): 1, (None, 1, 1): 1, (None, 2, 2): 1, (None, 1, 2): 1}
    asked = lambda df: {(r.dataset, r.cp1, r.cp2): r.n for r in df.collect()}
    assert asked(fr.counts(pages)) == want
    assert asked(fr.single_counts(pages)) == {k: n for k, n in want.items() if k[1] == k[2]}
    assert asked(fr.pair_counts(pages)) == {k: n for k, n in want.items() if k[1] < k[2]}


def test_codepoints_of_odd_texts(spark):
    from pageloom.sources import corpus

    texts = [None, "", "aab\n", "\U0001f600é\U0001f600", "\x00b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", corpus.codepoints(F.col("text")).alias("cps"))
    assert {r.i: r.cps for r in df.collect()} == {i: None if t is None else sorted({ord(c) for c in t}) for i, t in enumerate(texts)}
