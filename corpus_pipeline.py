"""The documents table made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs: toxic documents go; of lines that are alike one stays; of near
duplicates one document stays; sources are mixed to their target weights (documents that the mix
takes twice are there twice); texts are encoded into pieces.

Defined results, in all stages: null and empty texts count as texts without words (not toxic unless
the classifier's intercept says so, without lines, near duplicates of nothing); documents without
words are never part of a mix, so they end at the mixing stage; rows that repeat an id are
documents of their own, except that of near duplicates all rows with the id that stays do; rows
without an id stay documents of their own; empty tables give empty results; further columns are
carried along unchanged, whatever their names (n_chars follows the text where lines go).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from pageloom.llm.common import settle, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels that aren't held out, scores below its threshold."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that are alike to an earlier one; n_chars follows the text."""
    # The operator's own counts would take the place of columns of the same names.
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias("own"))
    left = line_dedup.dedup_lines(held)
    now = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    return left.select(*[now.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def _held(docs: DataFrame) -> DataFrame:
    """(own, doc_id, text, source, place): docs' columns in one struct and a place that no two rows share.

    Rows of files have one that each reading finds again; others are written down first.
    """
    own = F.struct(*docs.columns).alias("own")
    plain = [F.col(c) for c in ("doc_id", "text", "source")]
    try:
        return docs.select(own, *plain, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
    except AnalysisException:
        row = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias("place")
        return settle(docs.select(own, *plain, row))


def _keyed(docs: DataFrame) -> DataFrame:
    """(own, key, text): docs' columns in one struct, and the id or, where that is null, a number of the row's own past all ids."""
    held = _held(docs)
    bare = held.where("doc_id is null").select("place")
    if bare.isEmpty():
        return held.select("own", F.col("doc_id").alias("key"), "text")
    last = int(held.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0])
    named = settle(bare.select("place", (F.lit(max(last, 0)) + 1 + F.monotonically_increasing_id()).alias("new")))
    return held.join(named, "place", "left").select("own", F.coalesce("doc_id", "new").alias("key"), "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; null ids come last."""
    keyed = _keyed(docs)
    kept = near_dedup.near_duplicates(keyed.select("key", "text"), "key").where("kept").select(F.col("id").alias("key")).distinct()
    return keyed.join(kept, "key", "left_semi").select("own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents: taken words over size, rounded.

    Only documents that a block's bound cuts are rounded, so a source is off its target by no more
    than its schedule's discrepancy and half of such documents.
    """
    held = _held(docs)
    taken = mixing.mix(held.select("doc_id", "text", "source", "place"), carry=("place",)).where("taken > 0")
    times = taken.select("place", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    repeated = held.select("own", "place").join(times, "place").select("own", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return repeated.select("own.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each row's pieces."""
    return pieces.summary(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The classifier and the encoder can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages meet in Parquet tables in the cluster's shared folder."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        at = f"{place}/{number}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
