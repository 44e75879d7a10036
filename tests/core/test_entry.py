import importlib

import pytest


def test_every_query_with_sql_is_registered():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    e = importlib.import_module("__spark_entry__")
    rows = e.entry(spark).collect()
    assert len(rows) == 4 and all(r.bound_min <= r.bound_max + 1e-6 for r in rows)


@pytest.mark.parametrize("name", ["f3_probabilities", "f11_pair_bounds", "c4_or", "o9_frequency_order", "e1_sparse_bit_sets"])
def test_against_sql(spark, sf_dir, name):
    import duckdb

    e = importlib.import_module("__spark_entry__")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = e.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    ours = sorted(tuple(str(r[x]) for x in cols) for r in got.collect())
    theirs = c.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert ours == sorted(tuple(str(x) for x in r) for r in theirs)
