import importlib

import pytest


@pytest.mark.parametrize("name", ["m5_best_case", "m7_cost_deltas", "m8_inert_threshold", "m12_apply_merge", "m13_init_moves", "o14_best_candidate", "f25_fallback_cost_all_patches"])
def test_against_sql(spark, sf_dir, name):
    import duckdb

    e = importlib.import_module("__spark_entry__")
    name = name if name.startswith("f25") else f"{name}_by_dataset"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = e.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = got.collect()
    theirs = c.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()

    ours = sorted(tuple(r[x] for x in cols) for r in rows)
    theirs = sorted(tuple(r) for r in theirs)
    assert len(ours) == len(theirs)
    assert all(a == pytest.approx(b, abs=1e-5) if isinstance(a, float) else a == b for x, y in zip(ours, theirs) for a, b in zip(x, y))
    if "dataset" in cols and name != "o14_best_candidate_by_dataset" and name != "m13_init_moves_by_dataset":
        assert len({r.dataset for r in rows}) > 1


def test_or_groups_are_checked_against_the_segments_outside(spark):
    """G1 comes with 1 or 2, or with 3 and 4 together: the group {1, 2} isn't its whole condition; G2's group is."""
    from pageloom.operators import discover as dc

    analysis = spark.createDataFrame([(1, "G1", "or"), (2, "G1", "or"), (1, "G2", "or"), (2, "G2", "or"), (3, "G3", "and"), (4, "G3", "or")], "segment_id int, node string, kind string")
    either = dc.or_groups(analysis)
    assert sorted((r.node, r.segments) for r in either.collect()) == [("G1", [1, 2]), ("G2", [1, 2])]
    others = spark.createDataFrame([([1, 2], "G1"), ([1, 2], "G3")], "segments array<int>, node string")
    assert [(r.node, r.segments) for r in dc.additional(either, others).collect()] == [("G1", [1, 2])]
    assert dc.additional(either.limit(0), others).isEmpty()
