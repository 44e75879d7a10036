import random

import numpy as np

from pageloom.llm import near_dedup
from pageloom.llm.textnum import shingle_set


def brute(docs, percent=75):
    """{id: (n, component, kept)} by shared words of five, every pair that shares one."""
    import re

    sets = {}
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for a, s in sets.items():
        shared = {}
        for x in s:
            for b in by[x]:
                shared[b] = shared.get(b, 0) + 1
        for b, k in shared.items():
            if b != a and 100 * k >= percent * (len(s) + len(sets[b]) - k):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def got(rows):
    return {r.id: (r.n_shingles, r.component_id, r.kept) for r in rows}


def test_families_against_brute_force(spark):
    """Families whose members are often too far apart to be linked directly, and a passage that all share."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  two"), (5, "a b c d e"), (6, "A b c d E")]
    for family in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.choice([0, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text)))
    for _ in range(60):
        docs.append((len(docs), " ".join([rng.choice(words) for _ in range(40)] + passage)))
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    assert got(near_dedup.near_duplicates(df, id_col="id").collect()) == brute(docs)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(7, "x y z", "r"), (8, "x y z", "s")], "doc_id long, text string, id string")
    assert got(near_dedup.near_duplicates(df).collect()) == {7: (1, 7, True), 8: (1, 7, False)}
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_follows_similarity():
    rng = random.Random(1)
    for share in (0.3, 0.6, 0.9):
        a = [f"c{i}" for i in range(600)]
        b = [x if rng.random() < share else f"d{i}" for i, x in enumerate(a)]
        x, y = shingle_set(" ".join(a), 1), shingle_set(" ".join(b), 1)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        equal = (near_dedup.registers(x) == near_dedup.registers(y)).sum()
        assert abs(float(near_dedup.estimate(equal, len(x), len(y))) - true) < 0.2


def test_long_text_in_blocks():
    text = "word " * 300_000 + "end"
    assert len(shingle_set(text)) == 2
