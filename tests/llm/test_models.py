import random

import numpy as np

from pageloom.llm import neighbours, toxicity


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeionstr") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(60)] = "zgrub" + rng.choice(plain)
        rows.append((i, " ".join(words), "x", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "x", "s"), (901, "", "x", "s"), (902, "clean " * 50_000 + "zgrubben", "x", "s"), (0, rows[0][1], "x", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    kept = toxicity.keep_clean(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxic_scores(docs, none).collect()] == [0]
    assert toxicity.toxic_scores(docs.where("false"), none).collect() == []


def test_blocks_see_what_whole_texts_have():
    text = "".join(random.Random(1).choice("abc d") for _ in range(2 * toxicity.BLOCK + 100))
    spaced = "a" * 900 + " " * 500 + "?!" * 300 + "Σ b" * 200
    for t in (text, spaced, " " * 3000, ""):
        whole = {int(x) for _, h in toxicity.grams([t], 1 << 30) for x in h}
        for block in (97, 1000, toxicity.BLOCK):
            assert whole == {int(x) for _, h in toxicity.grams([t], block) for x in h}


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    texts = ["x" * (i * 997 % 5000) for i in range(300)] + [None, "y" * 90_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "no"])
    parts = list(toxicity.slices(batch, "text", rows=50, size=20_000))
    assert [x for p in parts for x in p.column("no").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 50 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 20_000) for p in parts)


def test_ties_of_scaled_vectors(spark):
    x = np.random.default_rng(5).normal(size=16)
    rows = [(i, [float(a * (1 + i % 20 / 7)) for a in x]) for i in range(60)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted(r.id for r in got if r.query_id == 0) == [1, 2, 3, 4, 5] and sorted(r.id for r in got if r.query_id == 50) == [0, 1, 2, 3, 4]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48))
    r = neighbours.rotated(x, 0)
    assert r.shape == (5, 64) and np.allclose(np.linalg.norm(r, axis=1), np.linalg.norm(x, axis=1))


def test_recall_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 64)).astype(np.float32)
    x[100:160] = x[50]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 64), (5100, [float("nan")] * 64), (5150, [None] * 64), (5200, [1.0, 2.0]), (5250, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2500, 50):
        s = u @ u[q]
        order = [i for i in sorted(range(2500), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({i for _, i, _ in mine} & set(order))
        assert all(abs(score - s[i]) < 1e-9 for _, i, score in mine)
    assert hits / 250 >= 0.9
    assert [i for _, i, _ in sorted(got[50])] == [100, 101, 102, 103, 104]
    assert [i for _, i, _ in got[5200]] == [5250] and [i for _, i, _ in got[5250]] == [5200]
    assert not {5000, 5050, 5100, 5150} & set(got)
    assert neighbours.nearest(df.where("false")).collect() == []
