"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's registers are minima of its shingles' hashes, one hash function a register (so
short documents have no empty registers), each compressed to a leading-zero count (6 bits) and
ten mantissa bits. Bands of three compressed registers name buckets; documents that share a
bucket are candidates. A candidate pair's Jaccard similarity is estimated from equal registers,
corrected for registers that agree by chance, and pairs that may reach the threshold are
confirmed on their full shingle sets. Components are found by distributed union-find.

No bucket's pairs are all emitted, and none is left out:
 1. documents with equal sets are one class from the start, by the smallest id;
 2. in every bucket each class is paired with one centre (another one in each band) and the two
    best centres of a class by estimate are confirmed; this joins nearly all that belongs together;
 3. buckets that still hold several components are searched in full for promising pairs between
    those, in cells of bounded size; what they connect is a cluster, and clusters are searched in
    full for links between their components, on full sets and again in cells.
A cell gives out a forest of what it found, not its pairs, and a pair inside one component needs
no check, so no link among candidates is lost.

Recall of candidates at a similarity of 0.75 is 1 - (1 - 0.75^3)^32, above 0.9999999; the
estimate's margin is four standard deviations.

Defined results: null, empty and separators-only texts have no shingles, are linked with nothing
and are components of their own; texts shorter than a shingle are one shingle; rows that repeat
an id share that id's links; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import components, free, settle, ship
from .setjoin import confirmed
from .textnum import mix, shingle_set

REGISTERS = 96
BAND_ROWS = 3
BANDS = REGISTERS // BAND_ROWS
TILE = 512
MANTISSA = 10

_FACTORS = mix(np.arange(1001, 1001 + REGISTERS, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(5001, 5001 + REGISTERS, dtype=np.uint64))


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers: leading zeros of the smallest hash, then its bits after the first one."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    part, exponent = np.frexp(least.astype(np.float64) + 1.0)
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    bits = np.minimum(((part * 2 - 1) * (1 << MANTISSA)), (1 << MANTISSA) - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | bits


def chance(n_a, n_b):
    """Probability that the registers of disjoint sets of these sizes agree.

    Minima are near exponential with rates n_a, n_b; a cell is 2^-10 of its octave wide, on the
    mean 1 / (2 ln 2) of that part of the value.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    return np.minimum(n_a * n_b / (n_a + n_b) ** 2 / (2 * np.log(2)) / (1 << MANTISSA), 0.5)


def estimate(equal, n_a, n_b):
    """Jaccard similarity from the number of equal registers, corrected for chance."""
    c = chance(n_a, n_b)
    return np.clip((np.asarray(equal, float) / REGISTERS - c) / (1 - c), 0, 1)


def margin(threshold: float) -> float:
    """The estimate from which a pair may reach the threshold: four standard deviations below it."""
    return threshold - 4 * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, regs = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                first.append(int(mix(s + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                second.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0xA24BAED4963EE407))).view(np.int64)) if len(s) else 0)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(regs, pa.binary())], names=["id", "n", "set_a", "set_b", "regs"]
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 64):
                found = [shingle_set(t.as_py(), words).view(np.int64) for t in texts[at : at + 64]]
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 64), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "set"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _matrix(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
        key = numbers + np.uint64(1)
        for k in range(BAND_ROWS):
            key = (key << np.uint64(16)) | regs[:, :, k]
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.reshape(-1).view(np.int64))], names=["id", "bucket"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        equal = (_matrix(batch.column("regs_a")) == _matrix(batch.column("regs_b"))).sum(axis=1)
        got = estimate(equal, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got)], names=["a", "b", "est"])


class _Forest:
    """Union-find over a few ids: keeps only links that join something."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[a] = b
        return a != b


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that are sorted by the keys, as one table for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if last is not None and (values[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sides(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the left and the right tile; a tile that meets itself is both."""
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    return left, right if len(right) else left


def _promising(threshold: float):
    """Cells of buckets -> (a, b): roots of components that have a pair with a promising estimate, as a forest for each cell."""
    least = margin(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("bucket", "ti", "tj")):
            roots, sides, sizes = (t.column(c).to_numpy() for c in ("root", "side", "n"))
            regs = _matrix(t.column("regs").combine_chunks())
            left, right = _sides(sides)
            forest, out = _Forest(), []
            for at in range(0, len(left), 64):
                i = left[at : at + 64]
                ok = roots[i][:, None] != roots[right][None, :]
                ok &= np.minimum(sizes[i][:, None], sizes[right][None, :]) >= threshold * np.maximum(sizes[i][:, None], sizes[right][None, :])
                x, y = np.nonzero(ok)
                for k in range(0, len(x), 8192):
                    u, v = i[x[k : k + 8192]], right[y[k : k + 8192]]
                    good = estimate((regs[u] == regs[v]).sum(axis=1), sizes[u], sizes[v]) >= least
                    for pair in np.unique(np.stack([roots[u][good], roots[v][good]], axis=1), axis=0).tolist():
                        if forest.join(*pair):
                            out.append(pair)
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _exact_links(percent: int):
    """Cells of clusters, with full sets -> (a, b): links between different roots, as a forest for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("cluster", "ti", "tj")):
            ids, roots, sides = (t.column(c).to_numpy() for c in ("id", "root", "side"))
            lists = t.column("set").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
            starts = starts - starts[0]
            sizes = np.diff(starts)
            here = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
            left, right = _sides(sides)
            names, often = np.unique(roots, return_counts=True)
            most = names[np.argmax(often)]
            forest, out = _Forest(), []
            # Pairs within the commonest root need no look, so one end of each pair is outside it.
            for one, other in ((left, right), (right, left)):
                picked = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in other])
                bounds = np.concatenate([[0], np.cumsum(sizes[other])[:-1]]).astype(np.int64)
                members = flat[picked]
                for i in one[roots[one] != most]:
                    here[flat[starts[i] : starts[i + 1]]] = 1
                    common = np.add.reduceat(here[members], bounds)
                    here[flat[starts[i] : starts[i + 1]]] = 0
                    good = (roots[other] != roots[i]) & (100 * common >= percent * (sizes[i] + sizes[other] - common))
                    for j in other[good]:
                        if forest.join(int(roots[i]), int(roots[j])):
                            out.append((int(ids[i]), int(ids[j])))
                if one is other:
                    break
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cells(rows: DataFrame, key: str, tiles) -> DataFrame:
    """rows(key, id, ..) dealt to cells (key, ti, tj) of two tiles each: tile i as side 0 meets tile j as side 1; (i, i) has tile i once."""
    dealt = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other"), "side": (F.col("tile") > F.col("other")).cast("int")})
    return dealt.drop("tiles", "tile", "other").repartition(key, "ti", "tj").sortWithinPartitions(key, "ti", "tj")


def _links_between(told: DataFrame, facts: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components that share a bucket. told(bucket, id, root), facts(id, n, regs).

    Buckets' pairs are rated by registers, cell by cell, and only a forest of promising ones comes
    out; it makes clusters of components, each document being in one. Within clusters, full sets
    are compared cell by cell, and again only a forest of the links comes out.
    """
    mixed = told.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("bucket", "m")
    rows = settle(told.join(mixed, "bucket").select("bucket", "m", "id", "root"))
    celled = _cells(rows.join(facts, "id"), "bucket", F.ceil(F.col("m") / TILE).cast("int"))
    near = celled.select("bucket", "ti", "tj", "side", "root", "n", "regs").mapInArrow(_promising(percent / 100), "a bigint, b bigint")
    clusters = components(near)
    own = settle(rows.select("id", "root").distinct().join(clusters.select(F.col("id").alias("root"), F.col("root").alias("cluster")), "root"))
    size = own.groupBy("cluster").agg(F.count("*").alias("m"))
    sets = own.join(size, "cluster").join(_sets_of(docs, own.select("id"), words), "id")
    celled = _cells(sets, "cluster", F.ceil(F.col("m") / TILE).cast("int"))
    return settle(celled.select("cluster", "ti", "tj", "side", "id", "root", "set").mapInArrow(_exact_links(percent), "a bigint, b bigint"))


def _sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(id, set) of the documents needed(id)."""
    return settle(docs.join(needed, "id", "left_semi").select("id", "text").mapInArrow(_sets(words), "id bigint, set array<bigint>"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row. Links: 100 * intersection >= percent * union."""
    threshold = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = settle(docs.mapInArrow(_signatures(words), "id bigint, n bigint, set_a bigint, set_b bigint, regs binary"))
    classes = settle(signed.where("n > 0 and id is not null").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.any_value("regs").alias("regs")))
    # A few buckets' members; most buckets have one member and go no further.
    banded = classes.select("rep", "regs").mapInArrow(_bands, "id bigint, bucket bigint").repartition("bucket")
    # The centre is the member smallest after mixing with the bucket's name; mixing again gives it back.
    least = F.min(F.xxhash64("bucket").bitwiseXOR(F.col("id"))).alias("least")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m"), least).where("m > 1").hint("shuffle_hash")
    members = settle(banded.join(shared, "bucket").select("bucket", "id", F.col("least").bitwiseXOR(F.xxhash64("bucket")).alias("centre")))
    del banded, shared
    free(docs)

    facts = classes.select(F.col("rep").alias("id"), "n", "regs")
    side_a = facts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    side_b = facts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    close = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")
    rated = stars.join(side_b, "b").join(side_a, "a").where(close).select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    rated = rated.mapInArrow(_estimates, "a bigint, b bigint, est double").where(F.col("est") >= margin(threshold))
    best = W.partitionBy("b").orderBy(F.desc("est"), "a")
    first = settle(rated.withColumn("no", F.row_number().over(best)).where("no <= 2").select("a", "b"))
    links = confirmed(first, _sets_of(docs, first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words), percent)
    roots = components(links)

    # What shares a bucket and isn't one component yet: all links between components.
    told = settle(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")))
    free(docs)
    more = _links_between(told, facts, docs, words, percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    named = classes.where("members > 1").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("n", "set_a", "set_b", F.coalesce("root", "rep").alias("class_root"))
    named = settle(named)
    alone = roots.withColumnRenamed("root", "own_root")
    rows = signed.select("id", "n", "set_a", "set_b").join(named, ["n", "set_a", "set_b"], "left").join(alone, "id", "left")
    component = F.coalesce("class_root", F.when(F.col("n") > 0, F.col("own_root")), "id")
    return rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN []
        ELSE list_distinct(list_transform(range(greatest(len(words) - 4, 1)), lambda i: array_to_string(words[i + 1 : i + 5], ' '))) END AS shingles
    FROM w
), n AS (
    SELECT doc_id, len(shingles) AS n FROM s
), x AS (
    SELECT doc_id, unnest(shingles) AS shingle FROM s
), c AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY 1, 2
), e AS (
    SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * common >= 75 * (na.n + nb.n - common)
), v AS (
    SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
    SELECT doc_id, doc_id AS reached FROM documents
    UNION
    SELECT r.doc_id, v.b FROM r JOIN v ON v.a = r.reached
), m AS (
    SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n.n AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN m USING (doc_id)
"""

ship(__name__)
