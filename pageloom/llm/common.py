"""Shared pieces: table access, cutting lineage, connected components."""

from __future__ import annotations

import gc
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.iterate import settle, shared_folder

__all__ = ["bitmap", "components", "free", "maybe", "packed", "per_worker", "settle", "shared_folder", "ship", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module_name: str) -> None:
    """Functions of the module travel to the executors by value, so that executors need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def per_worker(key: tuple, make):
    """make()'s result, made once in each Python process: functions shipped by value find it again in later tasks."""
    store = sys.__dict__.setdefault("_pageloom_made", {})
    if key not in store:
        store[key] = make()
    return store[key]


def free(df: DataFrame) -> None:
    """Ask the session to let go of what finished steps left behind.

    Spark deletes a shuffle's files when the plan that made them is garbage; on a driver with
    little to do that can be long after the files fill the disks.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


PACK_BYTES = 1 << 24


def _parts(df: DataFrame, size: int) -> tuple[DataFrame, int]:
    """packed(df, size) and how many parts its bytes make; 1: all of it has no more than size bytes."""
    shared_folder(df.sparkSession)
    cut = df.checkpoint(eager=True)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cut._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    held = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    rows = cut._jdf.queryExecution().toRdd()
    parts = max(1, -(-held // size))
    # As in settle(), a plan without an estimate.
    fresh = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, cut._jdf.schema(), False), spark)
    return (fresh.coalesce(parts) if parts < rows.getNumPartitions() or parts == 1 else fresh), parts


def packed(df: DataFrame, size: int | None = None) -> DataFrame:
    """settle(df), where one task reads as many of its parts as have some size bytes together; none is read by several.

    A table of few rows in many parts costs a task and some files a part in every step after it. What
    fits one task's share is then one part, and sums of such a table need no exchange.
    """
    return _parts(df, size or PACK_BYTES)[0]


BITMAP_BITS = 1 << 23


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """(word, bits): a bitmap of fixed size, 2^17 rows of 64 bits at most, with a bit for each key's hash."""
    bit = F.pmod(F.xxhash64(F.lit("bit"), column), F.lit(BITMAP_BITS))
    rows = keys.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("at"))
    return packed(rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")))


def maybe(df: DataFrame, column: str, bits: DataFrame, there: bool = True) -> DataFrame:
    """The rows whose key may be in the bitmap (all that are, some that aren't), or the others, which certainly aren't.

    The bitmap's size doesn't depend on the data, so every executor gets it; where very many keys
    fill it, it only lets more rows through. df's columns stay in one struct meanwhile, so that no
    name of theirs meets a helper's.
    """
    bit = F.pmod(F.xxhash64(F.lit("bit"), column), F.lit(BITMAP_BITS))
    asked = df.select(F.struct(*df.columns).alias("own"), F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("at"))
    met = asked.join(F.broadcast(bits), "word", "left")
    hit = F.coalesce(F.expr("(shiftright(bits, at) & 1L) = 1L"), F.lit(False))
    return met.where(hit if there else ~hit).select("own.*")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): returns (id, root) with the smallest id of each component.

    Distributed union-find: every round hooks each vertex to its smallest neighbour, shortens
    the paths, relabels the edges by what they hang on and drops those inside one tree, so edges
    only shrink. The parents of all rounds are then followed from the last round to the first. Ids that occur
    in no link are absent. Null ends are ignored. All state is in DataFrames. Every round takes edges
    away, so it ends by itself however long the chains are.
    """
    edges, parts = _parts(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), PACK_BYTES)
    # Nothing here has more rows than the edges have ends: if these are few, each join has its right side at hand.
    near = F.broadcast if parts == 1 else lambda table: table
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        # Both directions out of one row: a union would have twice the parts.
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        hooks = packed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("up")))
        for _ in range(2):  # pointer jumping, so that long chains shrink by a factor each round
            above = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(near(above), "up").select("id", F.col("top").alias("up"))
        hooks = packed(hooks)
        rounds.append(hooks)
        up_a = hooks.select(F.col("id").alias("a"), F.col("up").alias("ua"))
        up_b = hooks.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        edges = packed(
            edges.join(near(up_a), "a").join(near(up_b), "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # A vertex that vanished from the edges has its component's smallest id as its parent.
    known: DataFrame | None = None
    for hooks in reversed(rounds):
        if known is None:
            known = hooks.select("id", F.col("up").alias("root"))
        else:
            later = known.select(F.col("id").alias("up"), F.col("root").alias("top"))
            known = hooks.join(near(later), "up", "left").select("id", F.coalesce("top", "up").alias("root"))
    return packed(known)
