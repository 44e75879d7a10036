"""Secret scans: known forms, and sliding-window Shannon entropy over candidate strings.

Known forms are assignments to names of secrets, access key ids and long hex strings; each is
found leftmost first, without overlaps within its kind, and matches that fail its length go.

Candidates for the entropy scan are runs of 20 and more letters, digits and +/_=- . Each run is
told by its characters to be decimal, hexadecimal, of one letter case, or mixed, and has that
class's threshold. Over windows of 20 characters the entropy is log2(20) - S / 20 with S the sum
of c * log2(c) over the window's character counts c; these counts are carried along: moving the
window by one changes two of them, so S changes by two differences only. A run whose largest window entropy reaches the threshold
is a span of kind entropy, unless the allow list holds it: decimal numbers, UUID-like and path-like
runs, runs of words in one letter case joined by - _ or /, sequences in alphabetical or keyboard order, placeholders
(in what follows the last = or /: names and paths before a value say nothing of it).

Only built-in DataFrame functions are used. Offsets count code points, ends are exclusive. Texts
don't move: matches are found in place, and only their lengths are shuffled for the running sums
that make offsets of them.

Defined results: a null text counts as empty and has no spans; rows that repeat an id are
reported one by one (ties in offsets can't occur within a kind); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import settle

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (Java regex, least length of the match's last group)
KINDS = {
    "assign": (ASSIGN, 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),
    "entropy": (r"([A-Za-z0-9+/_=-]{20,})", 1, 20),
}
WINDOW = 20
#: The class of a run -> (its regex, least entropy in bits of its best window)
CLASSES = {
    "decimal": (r"^[0-9]+$", math.inf),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", 2.9),
    "lower": (r"^[a-z0-9]+$", 3.4),
    "upper": (r"^[A-Z0-9]+$", 3.4),
    "mixed": (r"^.*$", 3.7),
}
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Z]?[a-z]+([-_/=+][A-Z]?[a-z]+)*$",
    r"^[A-Z]+([-_/=+][A-Z]+)*$",
    r"^[-_=+/]+$",
    r"(?i)(example|sample|placeholder|changeme|dummy|lorem|xxxx|abcdefgh|12345678|qwerty)[^=/]*[=/]*$",
)


#: Characters of runs are told by their ASCII code less FIRST; counts up to WINDOW take BITS bits, PACKED of them one number.
FIRST, LAST, BITS, PACKED = ord("+"), ord("z"), 5, 12


def _gain(c: Column) -> Column:
    """What a sum of c * log2(c) gains where a count goes from c to c + 1: by table, as counts end at the window."""
    of = [0.0 if k < 2 else k * math.log2(k) for k in range(WINDOW + 2)]
    return F.get(F.array(*[F.lit(of[k + 1] - of[k]) for k in range(WINDOW + 1)]), c.cast("int"))


def window_entropy(run: Column) -> Column:
    """The largest Shannon entropy in bits of WINDOW successive characters of a run that is at least so long and has characters from + to z only.

    The window's counts by character are carried along, packed into a few numbers: a step lowers
    one count, raises another, and looks up what the sum loses and gains by that.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - FIRST)
    none = F.array(*[F.lit(0).cast("long")] * ((LAST - FIRST) // PACKED + 1))
    zero = F.struct(none.alias("counts"), F.lit(0.0).alias("s"), F.lit(math.inf).alias("least"))

    def word(c: Column) -> Column:
        return F.floor(c / PACKED).cast("int")

    def bit(c: Column) -> Column:
        return (c % PACKED) * BITS

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(c)), bit(c)).bitwiseAND((1 << BITS) - 1)

    def one(c: Column, number: Column) -> Column:
        return F.when(word(c) == number, F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        # x: the entering character and the one that leaves, null while the window fills.
        new, out = x["new"], x["out"]
        full = out.isNotNull()
        lost = F.when(full, _gain(count(acc["counts"], out) - 1)).otherwise(F.lit(0.0))
        s = acc["s"] - lost + _gain(count(acc["counts"], new) - F.when(full & (out == new), F.lit(1)).otherwise(F.lit(0)))
        counts = F.transform(acc["counts"], lambda w, k: w + one(new, k) - F.when(full, one(out, k)).otherwise(F.lit(0).cast("long")))
        least = F.when(x["last"], F.least(acc["least"], s)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), s.alias("s"), least.alias("least"))

    def best(c: Column) -> Column:
        moves = F.transform(c, lambda new, i: F.struct(new.alias("new"), F.get(c, i - WINDOW).alias("out"), (i >= WINDOW - 1).alias("last")))
        return F.aggregate(moves, zero, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / F.lit(float(WINDOW)))

    return F.get(F.transform(F.array(codes), best), 0)


def _suspicious(run: Column) -> Column:
    least = F.when(F.lit(False), F.lit(0.0))
    for pattern, bits in CLASSES.values():
        least = least.when(run.rlike(pattern), F.lit(bits))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    return ~allowed & (F.lit(math.log2(WINDOW)) >= least) & (window_entropy(run) >= least)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows(row, id) has every row of docs, spans(row, kind, start, end, match) what was found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("row", F.monotonically_increasing_id())
    each = []
    for kind, (pattern, group, least) in KINDS.items():
        has = F.col("t").rlike(pattern)
        matches = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        inner = F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
        # Java's split leaves out nothing in front, so piece i stands before match i.
        gaps = F.transform(F.split("t", pattern, -1), lambda g: F.length(g))
        items = F.transform(
            F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), inner.alias("inner")),
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                x["gap"].alias("gap"),
                F.length(x["match"]).alias("len"),
                F.when(F.length(x["inner"]) >= least, x["match"]).alias("match"),
            ),
        )
        each.append(F.when(has, items))
    empty = F.array().cast("array<struct<kind:string,gap:int,len:int,match:string>>")
    rows = settle(found.select("row", "id", *[F.coalesce(items, empty).alias(kind) for kind, items in zip(KINDS, each)]))
    parts = None
    for kind in KINDS:
        part = rows.where(F.size(kind) > 0).select("row", F.posexplode(kind).alias("pos", "x")).select("row", "pos", "x.*")
        parts = part if parts is None else parts.unionByName(part)
    upto = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where("match is not null")
    spans = placed.select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "match")
    return rows.select("row", "id"), spans.where((F.col("kind") != "entropy") | _suspicious(F.col("match")))


def query(spark, sf_dir: str) -> DataFrame:
    rows, spans = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    said = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("start", order.alias("no"), said.alias("said"))))
    told = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in KINDS],
        listed.alias("listed"),
    )
    known = F.filter("listed", lambda x: x["no"] < 4)
    none = F.lit(0).cast("long")
    return rows.join(told, "row", "left").select(
        F.col("id").alias("doc_id"),
        *[F.coalesce(f"n_{kind}", none).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce(F.concat_ws(",", F.transform(known, lambda x: x["said"])), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.concat_ws(",", F.transform("listed", lambda x: x["said"])), F.lit("")).alias("spans"),
    )
