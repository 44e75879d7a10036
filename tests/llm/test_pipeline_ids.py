import corpus_pipeline


def test_rows_without_ids_stay(spark):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(80))

    rows = [(1, text(1), "a"), (None, text(2), "a"), (None, text(2), "a"), (None, text(3), "b"), (2, text(4), "b"), (None, text(1), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = sorted((r.doc_id or 0, r.text) for r in left.collect())
    assert left.columns == docs.columns and got == sorted([(1, text(1)), (0, text(2)), (0, text(3)), (2, text(4))])
    plain = spark.createDataFrame([(i, t, "a") for i, t in enumerate([text(k) for k in range(6)])], docs.schema)
    bare = spark.createDataFrame([(None, r.text, r.source) for r in plain.collect()], docs.schema)
    assert corpus_pipeline.mix_sources(spark, plain, "").count() > 0
    assert corpus_pipeline.mix_sources(spark, bare, "").count() > 0


def test_columns_of_any_name_stay(spark):
    names = ["time", "times", "n_lines", "n_dropped", "_id", "_word", "_text_mark", "own", "key", "place", "taken", "size", "row", "id"]

    def text(k):
        return "\n".join(" ".join(f"w{k}x{i}y{j}" for i in range(30)) for j in range(3))

    docs = spark.createDataFrame([(i, text(i), "ab"[i % 2], len(text(i)), *[100 * i + n for n in range(len(names))]) for i in range(8)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all([r[n] for n in names] == [100 * r.doc_id + k for k in range(len(names))] for r in rows)
        assert stage(spark, docs.where("false"), "").collect() == []
