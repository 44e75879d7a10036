import hashlib
import random

from pageloom.llm import exact_dedup, mixing


def test_recipes_with_weak_hashes(spark):
    """Short identifiers of four bits clash all the time; numbering them keeps texts apart."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef .\n") for _ in range(300)) for _ in range(30)]
    texts = [base[rng.randrange(30)] for _ in range(60)] + ["", None, "", base[0][:-1] + "x", "é😀" * 50]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (4, 64):
        got = sorted((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df, least=16, most=64, bits=bits).collect())
        want = []
        for i, t in rows:
            same = [j for j, u in rows if (u or "") == (t or "")]
            want.append((i, max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want)


def test_chunks_hold_the_whole_text(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = ["".join(rng.choice("ab. \n漢😀") for _ in range(rng.randint(0, 900))) for _ in range(40)]
    texts += ["", "x" * 500, "\ufeffab" * 40, *["".join(rng.choice("漢字仮名交文") for _ in range(600)) for _ in range(20)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = F.transform(F.filter("s", lambda x: F.length(x) > 32), lambda x: exact_dedup._parts(x, 3))
    rows = df.withColumn("s", exact_dedup.stretches(F.col("t"), 8)).select("t", "s", parts.alias("parts")).collect()
    several = 0
    for r in rows:
        assert "".join(r.s) == r.t
        long = [x for x in r.s if len(x) > 32]
        assert all(p[-1] == 255 for of in r.parts for p in of)
        assert [b"".join(bytes(p[:-1]) for p in of).decode("utf-32-be") for of in r.parts] == long
        several += sum(len(of) > 1 for of in r.parts)
    assert several > 10


def test_an_edit_changes_few_chunks(spark):
    """Also where no sentence ends: what is put in front moves no later cut."""
    rng = random.Random(11)
    from pyspark.sql import functions as F

    for text in ("".join(rng.choice("ABCDabcd0123+/") for _ in range(60_000)), "".join(rng.choice("漢字仮名交文言葉") for _ in range(60_000)), "A line of words that ends. " * 10 + "".join(rng.choice("ab .") for _ in range(60_000))):
        df = spark.createDataFrame([(0, text), (1, "x" + text), (2, text[:30_000] + "yz" + text[30_000:])], "i int, t string")
        got = {r.i: [bytes(x.d) for x in r.refs] for r in df.select("i", exact_dedup.references(F.col("t")).alias("refs")).collect()}
        assert len(got[0]) > 20
        for i in (1, 2):
            assert len(set(got[i]) - set(got[0])) <= 3


def test_exact_empty_table_and_clashing_names(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a", 5), (None, "a", 6)], "doc_id long, text string, id long")
    assert sorted(((r.id or 0), r.keep_id, r.kept) for r in exact_dedup.exact_groups(df).collect()) == [(0, 1, False), (1, 1, True)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for s, n in (("a", 40), ("b", 200), ("c", 60), (None, 5)):
        rows += [(len(rows) + k, "w " * rng.randint(0, 30), s) for k in range(n)]
    rows.append((1000, None, "a"))
    df = docs(spark, rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    got = {r.id: r for r in mixing.mix(df, block=16).collect()}
    again = {r.id: r for r in mixing.mix(df.repartition(5), block=16).collect()}
    assert got == again and len(got) == len(rows)
    total = sum(size.values())
    by = {}
    for i, _, s in rows:
        r = got[i]
        assert r.size == size[i] and 0 <= r.taken <= 2 * r.size
        by.setdefault(s, []).append(r)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6
    for rs in by.values():
        # Off by the schedule's discrepancy, a few blocks of the words that a slot plays.
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 4 * 16 and rs[0].target <= 2 * rs[0].source_size + 1e-9
        assert all((r.n_slots > 0) == (r.taken > 0) == (r.first_slot is not None) for r in rs)


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds each source's share of slots."""
    df = docs(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(200)])
    rows = mixing.sized(df)
    goals = mixing.block_plan(mixing.targets(rows.groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "source_size")), 10)
    played = mixing.schedule(goals).collect()
    slots = sorted((r.slot, r.src) for r in played)
    wanted = {r.src: r.wanted / mixing.UNIT for r in goals.collect()}
    total, golden = round(sum(wanted.values())), (5**0.5 - 1) / 2
    assert slots == [(i, int((i * golden) % 1 >= wanted[0] / sum(wanted.values()))) for i in range(total)]
    share = sum(s == 0 for _, s in slots) / len(slots)
    for at in range(0, len(slots) - 50, 25):
        assert abs(sum(s == 0 for _, s in slots[at : at + 50]) - 50 * share) <= 4


def test_mix_repeated_rows(spark):
    df = docs(spark, [(1, None, "a"), (1, None, "a"), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (None, "z", None), (None, "z", None)])
    got = sorted((r.id or 0, r.size) for r in mixing.mix(df).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (1, 0), (1, 0), (2, 2), (2, 2)]


def test_mix_without_words(spark):
    got = mixing.mix(docs(spark, [(1, None, "a"), (2, " \t", None)])).collect()
    assert sorted((r.id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mix(docs(spark, [])).collect() == []
