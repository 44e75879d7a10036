"""License scans: fuzzy search for short notices.

Texts are lower-cased (A-Z) and read as words, joined by single spaces. A phrase may occur with up to
k edits. Split into k + 1 pieces, at least one piece of a phrase stands unchanged in such an
occurrence (pigeonhole), so the pieces are searched exactly, all phrases' at once with an
Aho-Corasick automaton; around each piece found, the regex library's bounded-error matching
verifies the edits on word bounds and reports the span. Phrase words of up to three letters must
stand as they are, since an edit of those makes other words of them.

Base places are those without edits: the phrase's words stand consecutively. A span's score is
1 - edits / length of the phrase; a document's score is its best span's.

Defined results: null and empty texts have no words and no labels, score 0; rows that repeat an
id are reported one by one; an empty table gives an empty result; further columns are ignored.
Texts are read whole; verified windows are remembered in a bounded table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_worker, ship

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: (phrase, label, edits allowed, whether its exact places are base places)
PHRASES = (
    ("mit license", "mit", 1, True),
    ("apache license", "apache", 1, True),
    ("general public license", "gpl", 2, True),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6, False),
    ("licensed under the apache license version 2 0", "apache", 3, False),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6, False),
    ("bsd 2 clause license", "bsd", 1, False),
    ("bsd 3 clause license", "bsd", 1, False),
    ("mozilla public license", "mpl", 2, False),
    ("eclipse public license", "epl", 2, False),
    ("lesser general public license", "lgpl", 2, False),
    ("affero general public license", "agpl", 2, False),
    ("creative commons attribution", "cc-by", 2, False),
    ("creative commons zero", "cc0", 2, False),
    ("boost software license", "bsl", 2, False),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5, False),
    ("all rights reserved", "proprietary", 1, False),
    ("spdx license identifier", "spdx", 2, False),
)


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    base: bool

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces of near equal length."""
        n, k = len(self.phrase), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled phrases; one for each Python worker."""

    def __init__(self, phrases=PHRASES):
        self.notices = [Notice(*p) for p in phrases]
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for no, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                seeds.setdefault(piece, []).append((no, offset))
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?![^ ])") for n in self.notices]
        self.short = [[w for w in n.phrase.split() if len(w) <= 3] for n in self.notices]
        self.verify = lru_cache(maxsize=65536)(self._verify)

    def _verify(self, no: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of every occurrence in the window."""
        found = []
        for m in self.patterns[no].finditer(window, overlapped=True):
            words, at = m.group().split(" "), 0
            for w in self.short[no]:  # in order, as they are
                while at < len(words) and words[at] != w:
                    at += 1
                at += 1
            if at <= len(words):
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
        return tuple(found)

    def spans(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice number, edits) in the plain text, sorted. Exact occurrences are all there; of overlapping occurrences of a notice the better ones."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, of) in self.automaton.iter(plain):
            for no, offset in of:
                n, k = len(self.notices[no].phrase), self.notices[no].edits
                lo, hi = max(0, end - size + 1 - offset - k), min(len(plain), end - size + 1 - offset + n + k)
                windows.setdefault(no, []).append((lo, hi))
        out = []
        for no, spots in windows.items():
            phrase, n = self.notices[no].phrase, len(self.notices[no].phrase)
            seen: set[tuple[int, int, int]] = set()
            last = None
            for lo, hi in sorted(spots):
                if (lo, hi) == last:
                    continue
                last = lo, hi
                # Whole words only: the window's ends move out to word bounds.
                a = plain.rfind(" ", 0, lo + 1) + 1 if lo else 0
                b = plain.find(" ", max(hi - 1, 0))
                b = len(plain) if b < 0 else b
                if b - a > 4 * n + 64:  # a very long word: nothing of it can belong to the phrase beyond the edits
                    a, b = max(a, lo - 1), min(b, hi + 1)
                for s, e, edits in self.verify(no, plain[a:b]):
                    if (a == 0 or plain[a + s - 1 : a + s] in ("", " ")) and plain[a + e : a + e + 1] in ("", " "):
                        seen.add((edits, a + s, a + e))
                # The best match of a window needn't be the exact one where several overlap.
                at = plain.find(phrase, a, b)
                while at >= 0:
                    if (at == 0 or plain[at - 1] == " ") and plain[at + n : at + n + 1] in ("", " "):
                        seen.add((0, at, at + n))
                    at = plain.find(phrase, at + 1, b)
            taken: list[tuple[int, int]] = []
            chosen = []
            for edits, s, e in sorted(seen):
                if edits == 0 or not _overlaps(taken, s, e):
                    chosen.append((s, e, no, edits))
                    _insert(taken, s, e)
            out += chosen
        return sorted(out)


def _overlaps(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    at = bisect_left(taken, (s, s))
    return (at < len(taken) and taken[at][0] < e) or (at > 0 and taken[at - 1][1] > s)


def _insert(taken: list[tuple[int, int]], s: int, e: int) -> None:
    insort(taken, (s, e))


def lowered(text: str | None) -> str:
    """The text with A-Z in lower case and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str | None, scanner: Scanner | None = None) -> tuple[int, list[tuple[int, int, str, int, bool, float]]]:
    """(number of words, [(first word, number of words, label, edits, base, score)]) of a text, by first word."""
    scanner = scanner or per_worker(("licenses", PHRASES), Scanner)
    words = WORD.findall(lowered(text))
    if not words:
        return 0, []
    plain = " ".join(words)
    found, at, no = [], 0, 0
    for s, e, n, edits in scanner.spans(plain):
        no += plain.count(" ", at, s)
        at = s
        notice = scanner.notices[n]
        found.append((no, plain.count(" ", s, e) + 1, notice.label, edits, notice.base and edits == 0, max(0.0, 1 - edits / len(notice.phrase))))
    return len(words), found


SPANS = "array<struct<first_word:bigint,words:bigint,label:string,edits:int,base:boolean,score:double>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
    for batch in batches:
        counts, spans = [], []
        for text in batch.column(1):
            n, found = scan(text.as_py())
            counts.append(n)
            spans.append([dict(first_word=f, words=w, label=label, edits=e, base=b, score=score) for f, w, label, e, b, score in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span))], names=["id", "n_words", "spans"])


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans) of every row; one pass over the table, nothing is shuffled."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(_run, f"id bigint, n_words bigint, spans {SPANS}")


def query(spark, sf_dir: str) -> DataFrame:
    found = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = "filter(spans, s -> s.base)"
    return found.selectExpr(
        "id as doc_id",
        "n_words",
        f"cast(size({base}) as bigint) as n_base",
        f"array_min(transform({base}, s -> s.first_word)) as first_word",
        f"array_max(transform({base}, s -> s.first_word)) as last_word",
        f"concat_ws(',', array_sort(array_distinct(transform({base}, s -> s.label)))) as base_labels",
        "concat_ws(',', array_sort(array_distinct(transform(spans, s -> s.label)))) as labels",
        "coalesce(array_max(transform(spans, s -> s.score)), 0.0D) as score",
    )


ship(__name__)
