"""Tables of few rows don't stay in as many parts as the session deals out."""

import random

from pageloom.llm import common


def _roots(pairs):
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_components_of_few_links_are_one_part_and_the_same_as_of_many(spark, monkeypatch):
    dice = random.Random(5)
    pairs = {(dice.randrange(3000), dice.randrange(3000)) for _ in range(1400)} | {(k, k + 1) for k in range(5000, 5020)}
    pairs = [p for p in pairs if p[0] != p[1]]
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    held = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("9", "false")):
        spark.conf.set(n, v)
    try:
        found = common.components(spark.createDataFrame(pairs, "a long, b long"))
        assert found.rdd.getNumPartitions() == 1
        assert {r.id: r.root for r in found.collect()} == _roots(pairs)
        monkeypatch.setattr(common, "PACK_BYTES", 256)
        found = common.components(spark.createDataFrame(pairs, "a long, b long"))
        assert found.rdd.getNumPartitions() > 1
        assert {r.id: r.root for r in found.collect()} == _roots(pairs)
    finally:
        for n, v in zip(names, held):
            spark.conf.set(n, v)
