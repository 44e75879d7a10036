import collections
import math
import random

import pytest

from pageloom.llm import secrets


def test_placeholder_words_before_a_value_hide_nothing(spark):
    found = ["EXAMPLE_SERVICE_KEY=Zx9QwT7bR2kLm4Vp8sNc", "sample/config/Zx9QwT7bR2kLm4Vp8sNcYh3F", "sample/Zx9QwT7bR2kLm4Vp8sNcYh3F=="]
    placeholders = ["KEY=exampleZx9QwT7bR2kLm4Vp8sNc", "config/Zx9QwT7bR2kLm4Vp8sampleYh3F=="]
    df = spark.createDataFrame(list(enumerate(found + placeholders)), "doc_id long, text string")
    rows, spans = secrets.secret_spans(df)
    got = {r.id for r in rows.join(spans.where("kind = 'entropy'"), "row").collect()}
    assert got == set(range(len(found)))


def test_window_entropy_against_recounted_windows(spark):
    rng = random.Random(3)
    every = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
    runs = ["".join(rng.choice(every[: rng.choice([1, 2, 5, 20, 67])]) for _ in range(rng.randint(20, 90))) for _ in range(300)]
    runs += ["a" * 20, "z" * 3000, "+z" * 10, every, "a" * 40 + every]
    df = spark.createDataFrame(list(enumerate(runs)), "i int, run string")
    for r in df.select("i", "run", secrets.window_entropy(df["run"]).alias("h")).collect():
        windows = [collections.Counter(r.run[j : j + 20]) for j in range(len(r.run) - 19)]
        assert r.h == pytest.approx(max(sum(-c / 20 * math.log2(c / 20) for c in w.values()) for w in windows), abs=1e-9)
