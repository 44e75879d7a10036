import importlib

from test_line_dedup import brute as fewer_lines
from test_near_dedup import brute as near_groups

import corpus_pipeline
from pageloom.llm import mixing, pieces, toxicity


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    scores = {r.doc_id: r.predicted for r in toxicity.query(spark, sf_dir).collect()}
    assert set(rows[1]) == {i for i, bad in scores.items() if not bad}
    left = fewer_lines([(i, r.text) for i, r in rows[1].items()])
    assert {i: r.text for i, r in rows[2].items()} == left and all(r.n_chars == len(r.text) for r in rows[2].values())
    assert set(rows[3]) == {i for i, (_, _, kept) in near_groups([(i, r.text) for i, r in rows[2].items()]).items() if kept}
    taken = {r.id: round(r.taken / r.size) if r.size else 0 for r in mixing.mix(seen[3]).collect()}
    times = {}
    for r in seen[4].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(abs(times.get(i, 0) - n) <= 1 for i, n in taken.items()) and set(times) <= {i for i, r in rows[3].items() if r.text.split()}
    v = pieces.vocabulary(pieces.MODEL)
    assert seen[5].count() == seen[4].count()
    for i, r in rows[5].items():
        assert r.exact and (r.n_chunks > 1 or r.n_tokens == len(v.encode(pieces.marked(rows[4][i].text))))


def test_registered():
    e = importlib.import_module("__spark_entry__")
    assert e.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
