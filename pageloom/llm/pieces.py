"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is encoded as the unigram model encodes: of all ways to cut it into pieces of the
vocabulary, the one with the largest sum of scores, found by dynamic programming over the
max-plus semiring. Giant texts are cut into chunks at fixed places. Between two chunks the state
is how far a piece reaches over the bound, 0 to L - 1 characters with L the longest piece, so
each chunk has an L x L transfer matrix of best scores, found without its neighbours. Products of
these matrices are associative: FAN neighbours at a time they are combined, level by level, to one
matrix of the whole text, and on the way down each level's states at its ends give those between
its parts, so no task handles more than FAN matrices of a text at once. Each chunk is then traced
back on its own. Scores are multiples of 2^-16, so sums are exact in whatever order they are made.

Inside a chunk, no piece has a space mark after another character, nor a line feed, so every path
passes the start of each word. The stretch between the first and the last
such place of a chunk is therefore the same for all entry and exit states, and words are looked
up in a bounded table of words solved before; only the chunk's head and tail are solved per state.
Texts without spaces have no such places and their chunks are solved per state throughout.

Vocabulary: the pieces of a .model file, whose path is a parameter. The public files hold
byte-pair pieces, whose scores are merge ranks and no probabilities; piece number r by rank gets
the score -log((r + OFFSET) * H), Zipf's law, H its normalising sum, rounded to 2^-16. Nothing is trained. Characters outside the
vocabulary become their UTF-8 bytes' pieces, each character at ten below the lowest score, as
the sentencepiece library scores unknown characters. Results are tested against that library's on
a model file with these scores: sums are equal, and so are ids where no other segmentation has the
same sum. Of equal sums the one with the longer last piece of a word is taken; where a chunk bound
falls into a word that has two best segmentations, either may come out.

Normalisation is the files' own: identity, a space mark for U+0020 and one in front of the text;
decoding undoes both, so decoding an encoding gives the text back exactly.

Defined results: null and empty texts have no pieces; a text with U+2581 of its own is encoded, but as in the library that
character decodes to a space, so exact is false;
rows that repeat an id are encoded one by one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, settle, ship
from .textnum import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65536
FAN = 16
OFFSET = 2.0
MARK = "▁"
_LOW = -1e300


class Vocabulary:
    """Pieces and scores, with encoder and decoder for whole strings of characters."""

    def __init__(self, pieces: list[str], kinds: list[int], offset: float = OFFSET):
        # kinds as in the file: 1 normal, 2 unknown, 3 control, 6 byte
        self.pieces, self.kinds = pieces, kinds
        self.bytes = {}
        normal = [i for i, k in enumerate(kinds) if k == 1]
        total = float(np.sum(1 / (np.arange(len(normal)) + offset)))
        # Scores are single precision in model files and in the library; these need 21 bits.
        scores = (np.round(-np.log((np.arange(len(normal)) + offset) * total) * 65536) / 65536).astype(np.float32)
        self.scores = dict(zip(normal, map(float, scores)))
        self.ids = {pieces[i]: i for i in normal}
        for i, k in enumerate(kinds):
            if k == 6:
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self.single = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), self.scores[i], i))
        self.automaton.make_automaton()
        self.utf8 = [bytes([int(p[3:5], 16)]) if k == 6 else p.encode() if k == 1 else b"" for p, k in zip(pieces, kinds)]
        # Words of one mark and other characters decouple if no piece has a mark elsewhere.
        self.apart = all(MARK not in p[1:] or not p.strip(MARK) for p in self.ids)
        # Nor does a piece span these, where no piece has them.
        bare = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.stretch = re.compile(rf"[{bare}]|{MARK}+[^{MARK}{bare}]*|[^{MARK}{bare}]+" if bare else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.word = lru_cache(maxsize=200_000)(self._solve)

    @staticmethod
    def read(path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kind = [6 if m.is_byte(i) else 3 if m.is_control(i) else 2 if m.is_unknown(i) else 5 if m.is_unused(i) else 1 for i in range(n)]
        return Vocabulary([m.id_to_piece(i) for i in range(n)], kind)

    def _steps(self, s: str) -> Iterator[tuple[int, int, float, int]]:
        """(end, length, score, id or -1 for a character that isn't in the vocabulary), by end, longest first."""
        if self.single.issuperset(s):
            for e, (n, score, piece) in self.automaton.iter(s):
                yield e + 1, n, score, piece
            return
        at = 0
        for e, (n, score, piece) in self.automaton.iter(s):
            for i in range(at, e + 1):
                if s[i] not in self.single:
                    yield i + 1, 1, self.unknown, -1
            at = e + 1
            yield e + 1, n, score, piece
        for i in range(at, len(s)):
            if s[i] not in self.single:
                yield i + 1, 1, self.unknown, -1

    def _solve(self, s: str) -> tuple[float, tuple[int, ...]]:
        """(best score, ids) of a string that starts and ends at piece bounds. Of equal sums the one with the longer last piece."""
        size = len(s)
        best = [_LOW] * (size + 1)
        best[0] = 0.0
        back: list = [None] * (size + 1)
        steps = self._steps(s) if not self.single.issuperset(s) else ((e + 1, *x) for e, x in self.automaton.iter(s))
        for end, n, score, piece in steps:
            total = best[end - n] + score
            if total > best[end]:
                best[end] = total
                back[end] = n, piece
        out: list[int] = []
        at = size
        while at:
            n, piece = back[at]
            at -= n
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.bytes[b] for b in reversed(s[at].encode("utf-8")))
        out.reverse()
        return best[size], tuple(out)

    def stretches(self, s: str) -> list[str]:
        """s cut at places that are bounds in every segmentation: before the marks that start a word, around characters that no piece has."""
        return self.stretch.findall(s) if self.apart else [s] if s else []

    def encode(self, s: str) -> list[int]:
        """Ids of a marked string, whole."""
        out: list[int] = []
        for w in self.stretches(s):
            out.extend((self.word(w) if len(w) <= 64 else self._solve(w))[1])
        return out

    def score(self, s: str) -> float:
        return sum((self.word(w) if len(w) <= 64 else self._solve(w))[0] for w in self.stretches(s))

    # Chunks. A chunk is the string s from its start, with up to longest - 1 characters beyond its end n.

    def _from(self, s: str, start: int, stop: int) -> np.ndarray:
        """Best scores from `start` to stop, stop + 1, ..: all pieces that start before stop end there or reach beyond."""
        size = min(len(s), stop + self.longest - 1)
        best = [_LOW] * (size + 1)
        if start <= size:
            best[start] = 0.0
        for end, n, score, _ in self._steps(s[:size]):
            if start <= end - n < stop:
                total = best[end - n] + score
                if total > best[end]:
                    best[end] = total
        out = np.full(self.longest, -np.inf)
        tail = np.array(best[stop : stop + self.longest])
        out[: len(tail)] = np.where(tail <= _LOW / 2, -np.inf, tail)
        return out

    def transfer(self, s: str, n: int) -> np.ndarray:
        """matrix[i, j]: best score from i characters into the chunk to j characters beyond its end.

        Where all paths share the stretch from the first to the last forced bound, its score is left
        out: a constant for the whole matrix changes no path.
        """
        size = self.longest
        places, at = [], 0
        for w in self.stretches(s[:n]):
            places.append(at)
            at += len(w)
        # Every path from any entry passes the stretches' starts behind the last possible entry.
        inside = [c for c in places if c >= size]
        if not inside:
            matrix = np.full((size, size), -np.inf)
            for i in range(size):
                if i < n:
                    matrix[i] = self._from(s, i, n)
                elif i - n < size:
                    matrix[i, i - n] = 0.0
            return matrix
        a, b = inside[0], inside[-1]
        head = np.array([self._from(s[:a], i, a)[0] for i in range(size)])
        return head[:, None] + self._from(s[b:], 0, n - b)[None, :]

    def trace(self, s: str, n: int, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that start in the chunk, entered `entry` characters in and left `leave` beyond its end."""
        end = n + leave
        return self.encode(s[entry:end]) if entry < end else []

    def decode(self, ids) -> str:
        return unmarked(b"".join(map(self.utf8.__getitem__, ids)).decode("utf-8", "replace"))


def marked(text: str | None) -> str:
    """Spaces as marks and one in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def unmarked(s: str) -> str:
    return s[1:].replace(MARK, " ") if s else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def between(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The states at the matrices' bounds on the best path from state `enter` before the first to `leave` behind the last.

    Suffix products give what is best from each state on; the path then steps through the bounds.
    """
    size = matrices[0].shape[0]
    rest = [np.full(size, -np.inf)]
    rest[0][leave] = 0.0
    for m in reversed(matrices):
        rest.append((m + rest[-1][None, :]).max(axis=1))
    rest.reverse()
    states = [enter]
    for m, after in zip(matrices, rest[1:]):
        states.append(int(np.argmax(m[states[-1]] + after)))
    return states


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def digest(ids) -> tuple[int, int]:
    """Two polynomials in the ids modulo 2^64, as signed numbers; those of joined lists follow from those of the parts."""
    flat = mix(np.asarray(ids, np.int64).astype(np.uint64) + np.uint64(1))
    if not _powers or len(_powers[0]) < len(flat):
        n = 1 << max(12, len(flat).bit_length())
        steps = [np.full(n, b, np.uint64) for b in _BASES]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.cumprod(s) for s in steps]
    return tuple(int((flat * p[: len(flat)]).sum(dtype=np.uint64).view(np.int64)) for p in _powers)


def joined(parts: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(n, a, b) of the joined list, from those of its parts in order."""
    n, sums = 0, [0, 0]
    for size, *of in parts:
        sums = [(t + x * pow(base, n, 1 << 64)) % (1 << 64) for t, x, base in zip(sums, of, _BASES)]
        n += size
    return n, *(int(np.uint64(t).view(np.int64)) for t in sums)


def vocabulary(path: str) -> Vocabulary:
    return per_worker(("vocabulary", path), lambda: Vocabulary.read(path))


FOUND = "row bigint, id bigint, chunk int, last int, odd boolean, part string, n bigint, a bigint, b bigint, exact boolean, ids array<int>"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
    names = ["row", "id", "chunk", "last", "odd", "part", "n", "a", "b", "exact", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _told(v: Vocabulary, part: str, entry: int, end: int, got: list[int], odd: bool, keep: bool) -> tuple:
    """(n, a, b, exact, ids) of a chunk's ids; a and b: their digest."""
    flat = np.asarray(got, np.int32)
    exact = not odd and b"".join(map(v.utf8.__getitem__, got)).decode("utf-8", "replace") == part[entry:end]
    return len(got), *digest(flat), exact, flat if keep else None


def _first(path: str, size: int, keep: bool):
    """Texts of one chunk -> what is told of them; longer ones -> their chunks, with what a piece can reach beyond each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out, held = [], 0
            for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                s, odd = marked(text), MARK in text
                last = max(0, (len(s) - 1) // size)
                if last:
                    for c in range(last + 1):
                        out.append((row, i, c, last, odd, s[c * size : (c + 1) * size + v.longest - 1], None, None, None, None, None))
                else:
                    out.append((row, i, 0, 0, odd, None, *_told(v, s, 0, len(s), v.encode(s), odd, keep)))
                held += len(s)
                if held > 1_000_000:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    return run


def _traced(path: str, size: int, keep: bool):
    """Chunks with their entry and exit states -> what is told of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                out = []
                for r in batch.slice(at, 16).to_pylist():
                    end = min(size, len(r["part"])) + r["leave"]
                    got = v.encode(r["part"][r["entry"] : end]) if r["entry"] < end else []
                    out.append((r["row"], r["id"], r["chunk"], r["last"], r["odd"], None, *_told(v, r["part"], r["entry"], end, got, r["odd"], keep)))
                yield _rows(out)

    return run


def _matrices(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                found = [v.transfer(p, min(size, len(p))).tobytes() for p in some.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("chunk"), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])

    return run


def _blobs(blobs: list[bytes]) -> list[np.ndarray]:
    size = int(round((len(blobs[0]) / 8) ** 0.5))
    return [np.frombuffer(b).reshape(size, size) for b in blobs]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, chunk, matrices in order) -> (row, chunk, matrix): their product."""
    for batch in batches:
        found = [reduce(product, _blobs(b)).tobytes() for b in batch.column("blobs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, chunk, matrices in order, entry, leave) -> (row, part, entry, leave) of the parts, FAN of which are a chunk."""
    for batch in batches:
        for r in batch.to_pylist():
            s = between(_blobs(r["blobs"]), r["entry"], r["leave"])
            n, first = len(r["blobs"]), r["chunk"] * FAN
            parts = [pa.array([r["row"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array(s[:-1], pa.int32()), pa.array(s[1:], pa.int32())]
            yield pa.RecordBatch.from_arrays(parts, names=["row", "chunk", "entry", "leave"])


def _scan(matrices: DataFrame, last: int) -> DataFrame:
    """(row, chunk, matrix) -> (row, chunk, entry, leave): up by products of FAN matrices, down by states. last: the largest chunk number."""
    levels = []
    while True:
        grouped = matrices.groupBy("row", F.floor(F.col("chunk") / FAN).cast("int").alias("group")).agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("found"))
        grouped = settle(grouped.select("row", F.col("group").alias("chunk"), F.transform("found", lambda x: x["matrix"]).alias("blobs")))
        levels.append(grouped)
        last //= FAN
        if not last:
            break
        matrices = grouped.mapInArrow(_products, "row bigint, chunk int, matrix binary")
    states = levels[-1].select("row", "chunk", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for grouped in reversed(levels):
        states = grouped.join(states, ["row", "chunk"]).select("row", "chunk", "blobs", "entry", "leave").mapInArrow(_states, "row bigint, chunk int, entry int, leave int")
    return settle(states)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, size: int = CHUNK, keep: bool = True) -> DataFrame:
    """(row, id, chunk, last, n, a, b, exact, ids): each row's pieces by chunk; exact: decoding gives the chunk's characters back.

    keep: whether the ids themselves come out (else null); a and b: their digest. Texts of one
    chunk are done where they stand. Chunks of longer texts are dealt out by (row, chunk), so that
    one giant text is spread over the cluster; of its matrices, FAN at a time meet.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = settle(numbered.mapInArrow(_first(model, size, keep), FOUND))
    out = ["row", "id", "chunk", "last", "n", "a", "b", "exact", "ids"]
    last = int(found.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0])
    if not last:
        return found.select(*out)
    long = found.where("last > 0").select("row", "id", "chunk", "last", "odd", "part").repartition("row", "chunk")
    states = _scan(long.select("row", "chunk", "part").mapInArrow(_matrices(model, size), "row bigint, chunk int, matrix binary"), last)
    traced = long.join(states, ["row", "chunk"]).mapInArrow(_traced(model, size, keep), FOUND)
    return found.where("last = 0").select(*out).unionByName(traced.select(*out))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [joined([(p["n"], p["a"], p["b"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
        n, a, b = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), batch.column("n_chunks"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch.column("exact")], names=["id", "n_tokens", "n_chunks", "a", "b", "exact"])


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, size: int = CHUNK) -> DataFrame:
    """(id, n_tokens, n_chunks, ids_digest, exact) of every row.

    ids_digest: 32 hexadecimal digits of the row's whole list of ids, the same however the text
    was cut into chunks.
    """
    told = encoded(docs, id_col, text_col, model, size, keep=False)
    single = told.where("last = 0").select("id", F.col("n").alias("n_tokens"), F.lit(1).cast("long").alias("n_chunks"), "a", "b", "exact")
    rows = told.where("last > 0").groupBy("row").agg(F.any_value("id").alias("id"), F.count("*").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("chunk", "n", "a", "b"))).alias("parts"), F.bool_and("exact").alias("exact"))
    whole = rows.select("id", "n_chunks", "parts", "exact").mapInArrow(_joined, "id bigint, n_tokens bigint, n_chunks bigint, a bigint, b bigint, exact boolean")
    digits = F.lower(F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")))
    return single.unionByName(whole).select("id", "n_tokens", "n_chunks", digits.alias("ids_digest"), "exact")


def query(spark, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ship(__name__)
