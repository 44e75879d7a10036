"""Toxicity: a character n-gram linear classifier over naive Bayes log-count ratios.

Features are the presence of character n-grams (4 to 6 characters of the lower-cased text, what
isn't a letter or digit being one space). On the labelled rows, every n-gram gets its log-count
ratio r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)) from the toxic documents p of P and
the others q of Q that have it; every n-gram whose likelihood ratio test tells the classes apart
at the level `significance` is a feature; a logistic regression with an L2 penalty is fitted on
presence * r.

Bound of the fit, a parameter: at most about `labelled` labelled rows, drawn evenly by a hash of
their id; what reaches the driver follows from these rows. Counting runs on the executors over whole
texts. Scoring reads every whole text, long ones in blocks that carry the last characters over the
cut, so that a text has the same n-grams whatever the block size.

Defined results: null, empty and separators-only texts have no n-grams and get the score of the
intercept; without labelled rows of both classes every score is the labelled share of toxic rows
(0 without any); rows that repeat an id are scored one by one, and of labels that repeat an id the
largest counts; null labels are no labels; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship
from .textnum import mix

GRAMS = (4, 5, 6)
BLOCK = 1 << 18
THRESHOLD = 0.3

_STEPS = mix(np.arange(11, 11 + max(GRAMS), dtype=np.uint64)) | np.uint64(1)
_PLAIN = np.full(0x80, 32, np.uint32)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)


def _points(lowered: str) -> np.ndarray:
    """Code points, what isn't a letter or digit being a space."""
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x80, _PLAIN[np.minimum(points, 0x7F)], points)


def _blocks(texts: list[str | None], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, code point) of the texts with one space for runs of them, about `block` characters at a time.

    A longer text comes in several blocks; each but the first starts with the characters that an
    n-gram across the cut needs.
    """
    owners, pieces, size = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        points = _points("".join(pieces))
        owner = np.repeat(np.asarray(owners), [len(p) for p in pieces])
        space = points == 32
        keep = np.concatenate([[True], ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))])
        return owner[keep], points[keep]

    for i, text in enumerate(texts):
        lowered = f" {(text or '').lower()} "
        if len(lowered) > block:
            carried = np.empty(0, np.uint32)
            for at in range(0, len(lowered), block):
                points = np.concatenate([carried, _points(lowered[at : at + block])])
                space = points == 32
                points = points[np.concatenate([[True], ~(space[1:] & space[:-1])])]
                yield np.full(len(points), i), points
                carried = points[-(max(GRAMS) - 1) :]
            continue
        owners.append(i)
        pieces.append(lowered)
        size += len(lowered)
        if size >= block:
            yield joined()
            owners, pieces, size = [], [], 0
    if pieces:
        yield joined()


def grams(texts: list[str | None], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, n-gram hash), with repeats."""
    for owner, points in _blocks(texts, block):
        points = points.astype(np.uint64)
        sums = np.zeros(len(points), np.uint64)
        for n in range(max(GRAMS)):
            end = len(points) - n
            if end <= 0:
                break
            sums = sums[:end] + points[n:] * _STEPS[n]
            if n + 1 in GRAMS:
                same = owner[:end] == owner[n:]
                yield owner[:end][same], mix(sums[same] + np.uint64(n + 1))


def slices(batch: pa.RecordBatch, text_col: str, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, unless one text is longer, bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


@dataclass
class Model:
    """keys: sorted n-gram hashes; weights: of each one's presence (ratio and coefficient multiplied)."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    seen: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.seen is None:  # most n-grams are no features: a table of 2^20 answers nearly all of them
            self.seen = np.zeros(1 << 20, bool)
            self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number), sorted."""
        found = [np.empty(0, np.int64)]
        if len(self.keys):
            for owner, h in grams(texts):
                maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
                h, owner = h[maybe], owner[maybe]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                good = self.keys[at] == h
                found.append(np.unique(owner[good] * len(self.keys) + at[good]))
        both = np.unique(np.concatenate(found))
        return both // max(len(self.keys), 1), both % max(len(self.keys), 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        owner, feature = self.hits(texts)
        z = self.bias + np.bincount(owner, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> the documents of each class that have an n-gram, summed up over some batches."""
    held: list[np.ndarray] = []
    labels: list[np.ndarray] = []

    def out():
        h, y = np.concatenate(held), np.concatenate(labels)
        order = np.argsort(h, kind="stable")
        h, y = h[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.diff(np.concatenate([first, [len(h)]]))
        toxic = np.add.reduceat(y, first)
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((total - toxic).astype(np.int64))], names=["h", "p", "q"])

    for batch in batches:
        for some in slices(batch, "text", rows=64):
            parts = [_distinct(o, h) for o, h in grams(some.column("text").to_pylist())]
            # A long text's blocks come apart: distinct once more over all of them.
            o, h = (np.concatenate([p[:, k] for p in parts]) for k in (0, 1)) if parts else (np.empty(0, np.uint64),) * 2
            pairs = _distinct(o, h)
            held.append(pairs[:, 1])
            labels.append(some.column("toxic").to_numpy().astype(np.int64)[pairs[:, 0].astype(np.int64)])
            if sum(map(len, held)) > 4_000_000:
                yield out()
                held, labels = [], []
    if sum(map(len, held)):
        yield out()


def _distinct(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, owner))
    owner, h = owner[order].astype(np.uint64), h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.stack([owner[new], h[new]], axis=1)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on a sparse matrix, by accelerated gradient steps."""
    n = len(y)
    w, b = np.zeros(n_features), 0.0
    vw, vb = w.copy(), b
    # A bound of the loss's curvature: a quarter of the largest row sum times the largest column sum.
    by_row = np.bincount(rows, np.abs(values), minlength=n).max(initial=1e-9) + 1
    by_col = max(np.bincount(cols, np.abs(values), minlength=n_features).max(initial=1e-9), n)
    step = 1 / (0.25 * by_row * by_col + penalty)
    for k in range(steps):
        z = vb + np.bincount(rows, values * vw[cols], minlength=n)
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        nw = vw - step * (np.bincount(cols, values * off[rows], minlength=n_features) + penalty * vw)
        nb = vb - step * off.sum()
        pace = k / (k + 3)
        vw, vb = nw + pace * (nw - w), nb + pace * (nb - b)
        w, b = nw, nb
    return w, float(b)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = 12_000, significance: float = 1e-6) -> Model:
    """Fit on the labels(id, toxic 0/1) that aren't held out, with the texts of docs."""
    known = labels.where("toxic is not null").where(~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    known = settle(known.select(F.col(id_col).alias("id"), "toxic"))
    total = known.count()
    part = min(1.0, labelled / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else known
    # At most about `labelled` rows of two numbers each: small enough to send to every executor.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("text", "toxic")
    texts = settle(texts.repartition(max(1, min(256, labelled // 500))))
    n1, n0 = (int(x or 0) for x in texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n1 or not n0:
        share = n1 / max(n1 + n0, 1)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))) if share not in (0.0, 1.0) else (-1e3 if share == 0 else 1e3))
    counts = texts.mapInArrow(_count, "h bigint, p bigint, q bigint").groupBy("h").agg(F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))

    def term(k, e):
        return F.when(k > 0, k * F.log(k / e)).otherwise(0.0)

    n, p, q = n1 + n0, F.col("p"), F.col("q")
    have = p + q
    gain = term(p, have * n1 / n) + term(q, have * n0 / n) + term(n1 - p, (n - have) * n1 / n) + term(n0 - q, (n - have) * n0 / n)
    ratio = F.log((p + 1) / (n1 + 2)) - F.log((q + 1) / (n0 + 2))
    # Twice the gain is chi-squared with one degree of freedom where the classes don't differ.
    least = NormalDist().inv_cdf(1 - significance / 2) ** 2
    chosen = counts.where(2 * gain >= least).select("h", ratio.alias("r")).toPandas()
    keys = chosen["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, ratios = keys[order], chosen["r"].to_numpy(float)[order]
    bare = Model(keys, np.zeros(len(keys)), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                owner, feature = bare.hits(some.column("text").to_pylist())
                ends = np.searchsorted(owner, np.arange(some.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))], names=["toxic", "has"])

    table = texts.mapInArrow(present, "toxic int, has array<int>").toArrow().combine_chunks()
    y = table.column("toxic").to_numpy().astype(float)
    has = table.column("has").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    has = has.chunk(0) if isinstance(has, pa.ChunkedArray) else has
    sizes = np.diff(has.offsets.to_numpy())
    cols = has.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(y)), sizes)
    w, b = fit_logistic(rows, cols, ratios[cols], y, len(keys))
    return Model(keys, w * ratios, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns but the text, and score (0 to 1)."""
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col):
                scores = model.scores(some.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in others], pa.array(scores)], names=[*others, "score"])

    return docs.mapInArrow(run, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = fit(docs, labels, id_col, text_col, **bounds)
    scored = score(docs.select(id_col, text_col), model, id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are."""
    model = fit(docs, labels, id_col, text_col, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col):
                yield some.filter(pa.array(model.scores(some.column(text_col).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return toxic_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ship(__name__)
