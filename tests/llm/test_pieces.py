import random

import pytest
import sentencepiece

from pageloom.llm import pieces


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.MODEL)


@pytest.fixture(scope="module")
def library(v):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = v.scores[i]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def score(v, ids):
    return sum(v.scores.get(i, 0.0) for i in ids)


def samples(alphabets, n, most, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, most))) for a in alphabets for _ in range(n)]


def test_like_the_library(v, library):
    texts = samples(["abtheingé漢😀 \n\t 0x", "the of and in ", "abthe", "  a"], 200, 60) + ["Hello  world\n\ttest  é 漢😀"]
    for t in texts:
        ours, theirs = v.encode(pieces.marked(t)), library.encode(t)
        assert v.decode(ours) == t
        assert len(ours) == len(theirs) or abs(score(v, ours) - score(v, theirs)) < 1e-3
        assert abs(score(v, ours) - score(v, theirs)) < 1e-3


def test_chunks_reach_the_same_sum(v):
    rng = random.Random(8)
    for t in samples(["abtheing", "the of and in ", "ab 漢", "the \n"], 60, 250, seed=4):
        s = pieces.marked(t)
        if not s:
            continue
        size = rng.randint(v.longest + 1, 60)
        parts = [s[i : i + size + v.longest - 1] for i in range(0, len(s), size)]
        states = pieces.between([v.transfer(p, min(size, len(p))) for p in parts])
        out = [x for p, e, l in zip(parts, states, states[1:]) for x in v.trace(p, min(size, len(p)), e, l)]
        assert v.decode(out) == t
        assert abs(score(v, out) - score(v, v.encode(s))) < 1e-6


def test_products_are_associative(v):
    import numpy as np

    a, b, c = (np.random.default_rng(k).normal(size=(4, 4)) for k in range(3))
    assert np.allclose(pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c)))


def test_rows(spark, v):
    rng = random.Random(2)
    long = " ".join("".join(rng.sample("abcdefgh", rng.randint(1, 8))) for _ in range(700))
    rows = [(1, "a b"), (2, None), (3, ""), (4, long), (4, long), (5, "x" * 900), (6, "has ▁ mark")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in pieces.encoded(df, size=256).collect():
        got.setdefault(r.row, []).append(r)
    assert len(got) == len(rows)
    texts = sorted((rs[0].id, pieces.unmarked("".join(v.utf8[i].decode() if v.kinds[i] == 1 else "" for r in sorted(rs, key=lambda r: r.chunk) for i in r.ids))) for rs in got.values())
    assert (4, long) in texts and (1, "a b") in texts and (5, "x" * 900) in texts and (2, "") in texts
    told = {r.id: r for r in pieces.summary(df, size=256).collect()}
    assert told[4].n_chunks > 3 and told[4].exact and told[2].n_tokens == 0 and not told[6].exact
    # Several levels of products, and the same digests whatever the chunks, where no two ways tie.
    other = {r.id: r for r in pieces.summary(df, size=64).collect()}
    whole = {r.id: r for r in pieces.summary(df).collect()}
    assert other[4].n_chunks > pieces.FAN and whole[4].n_chunks == 1
    assert all(told[i].ids_digest == other[i].ids_digest == whole[i].ids_digest and told[i].n_tokens == whole[i].n_tokens for i in (1, 2, 3, 6))
    assert len({x[4].n_tokens for x in (told, other, whole)}) == 1 and told[4].ids_digest == whole[4].ids_digest
    assert pieces.summary(spark.createDataFrame([], "doc_id long, text string")).collect() == []
