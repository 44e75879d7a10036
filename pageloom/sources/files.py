"""Files: codepoint lists, frequency records, sharded paths, plans, patches by URL."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = re.compile(r"-\d{5}-of-\d{5}$")


def blobs(spark, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def codepoint_list(spark, path: str) -> DataFrame:
    """(ord, codepoint, frequency) of a list with one 0xHEX[,frequency] a line.

    Blank lines and those that start with # are skipped, what follows a space is ignored; order and
    repeats stay. A line without 0x, a bad number or one that is too large fails the read.
    """
    lines = spark.read.text(path, wholetext=False).coalesce(1).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("line"))
    lines = lines.where("line <> '' and not startswith(line, '#')").withColumn("word", F.split("line", " ")[0])
    hexes = F.regexp_extract("word", r"^0x([0-9A-Fa-f]{1,8})(?:,|$)", 1)
    freq = F.regexp_extract("word", r"^0x[0-9A-Fa-f]{1,8},(.*)$", 1)
    count = F.try_to_number(freq, F.lit("99999999999999999999")).try_cast("long")
    wrong = (hexes == "") | ((freq != "") & (count.isNull() | ~freq.rlike("^[0-9]+$")))
    bad = F.raise_error(F.concat(F.lit("not a codepoint line: "), F.col("line")))
    return lines.select(
        "ord",
        F.when(wrong, bad.cast("int")).otherwise(F.conv(F.when(hexes == "", "0").otherwise(hexes), 16, 10).cast("int")).alias("codepoint"),
        F.when(freq != "", count).alias("frequency"),
    )


def by_frequency(codepoints: DataFrame) -> DataFrame:
    """Likely ones first, unknown ones last, then by codepoint."""
    return codepoints.orderBy(F.col("frequency").desc_nulls_last(), "codepoint")


def shards(spark, path: str) -> list[str]:
    """The files that path@* names, sorted, or the path itself; none is an error. Listed through Hadoop, so any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    wild = path.endswith("@*")
    at = jvm.org.apache.hadoop.fs.Path(path[:-2] + "*" if wild else path)
    found = at.getFileSystem(conf).globStatus(at) or []
    names = sorted(s.getPath().toString() for s in found)
    names = [n for n in names if SHARD.search(n)] if wild else names
    if not names:
        raise FileNotFoundError(path)
    return names


def frequency_records(spark, *paths: str) -> DataFrame:
    """(cp1, cp2, count) of records (codepoints array of one or two, count); other sizes fail the read."""
    rows = spark.read.schema("codepoints array<int>, count long").json(list(paths))
    n = F.size("codepoints")
    first, last = F.element_at("codepoints", 1), F.element_at("codepoints", -1)
    bad = F.raise_error(F.lit("a record needs one or two codepoints")).cast("int")
    return rows.select(F.when(n.between(1, 2), F.least(first, last)).otherwise(bad).alias("cp1"), F.greatest(first, last).alias("cp2"), "count")


def join_path(base: str, sub: str) -> str:
    """base/sub; a sub path that is absolute or leaves the base is an error."""
    whole = posixpath.normpath(posixpath.join(base, sub))
    if posixpath.isabs(sub) or not (whole + "/").startswith(posixpath.normpath(base) + "/"):
        raise PermissionError(sub)
    return whole


def write_patches(patches: DataFrame, path: str) -> None:
    """(url, bytes) rows as a table in any store."""
    patches.select("url", "bytes").write.mode("overwrite").parquet(path)


def write_plan(segments: DataFrame, patches: DataFrame, conditions: DataFrame, path: str) -> None:
    """A plan as three tables: segments(segment_id, cp), patches(condition_id, gid), conditions(condition_id, groups)."""
    segments.write.mode("overwrite").parquet(f"{path}/segments")
    patches.write.mode("overwrite").parquet(f"{path}/patches")
    conditions.write.mode("overwrite").parquet(f"{path}/conditions")


def read_plan(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("segments", "patches", "conditions"))


#: Defaults of a cost configuration.
COST_DEFAULTS = {"overhead": 75, "best_case": 0.5, "init_font_threshold": None, "optimization_cutoff": 0.0, "use_bigrams": True}


def cost_config(base: str | None = None, override: str | None = None) -> dict:
    """A configuration from JSON texts: defaults, then the base, then the override; unknown names are an error."""
    out = dict(COST_DEFAULTS)
    for text in (base, override):
        given = json.loads(text) if text else {}
        if wrong := set(given) - set(COST_DEFAULTS):
            raise ValueError(f"unknown settings: {sorted(wrong)}")
        out |= given
    return out
