"""Fixpoints over DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's spark.checkpoint.dir. Only one machine alone may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder; on a cluster it must, one that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pageloom-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the session's shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    cut = df.checkpoint(eager=True)
    # A checkpoint keeps the estimated size of the plan that made it, and joins multiply estimates:
    # over the rounds of a fixpoint they become numbers of millions of digits that stall the
    # driver. The same rows under a plan without an estimate are planned by what is measured.
    spark = df.sparkSession
    fresh = spark._jsparkSession.internalCreateDataFrame(cut._jdf.queryExecution().toRdd(), cut._jdf.schema(), False)
    return DataFrame(fresh, spark)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Grow a set of rows: add what step() finds of all rows so far, until nothing is new.

    Every round adds rows of a finite set, so it ends by itself however deep the input is.
    """
    known = settle(start.distinct())
    while True:
        new = settle(step(known).select(*known.columns).distinct().join(known, list(known.columns), "left_anti"))
        if new.isEmpty():
            return known
        known = settle(known.unionByName(new))


def labels(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, root): smallest id of each connected component, by smallest-neighbour labels and pointer jumping."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both)
    known = settle(both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")))
    while True:
        near = both.join(known.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = known.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        hooked = settle(hooked)
        above = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        jumped = settle(hooked.join(above, "root").select("id", F.col("top").alias("root"), "old"))
        known = jumped.select("id", "root")
        if jumped.where("root <> old").isEmpty():
            return known
