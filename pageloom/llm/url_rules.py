"""URL filters: listed rules, and rules mined from what they block.

Listed rules name a host and the start of a path; a rule fits its host and all subdomains, the
longest fitting rule decides. Their verdicts label the pages (block, or not), FP-growth mines the
combinations of URL tokens that go with block, and what passes the bounds of support (a share of
pages and a count) and confidence becomes a mined rule. Mined rules match by an inverted index:
each stands under its rarest token, a page looks its tokens up there, and the few rules found are
compared in full. Pages that no listed rule decides are blocked if a mined rule fits, else allowed.

Tokens of a URL: its scheme, its host's suffixes of one, two and more labels, its path's
segments with their depth, its last segment's extension, names of its query's parameters, and
that it has a fragment. Numbers are one token, as they are no more than names of pages.

Bounds: FP-growth's frequent tokens, and so its driver-side table, are bounded by 1 / support
times the tokens of a URL; antecedents have up to three tokens.

Defined results: null URLs and those without :// have an empty host and path, fit no rule and
have no tokens, and are allowed; rows that repeat an id
are judged one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: (verdict, rule): host, then the start of the path
LISTED = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
SUPPORT = 0.005
LEAST_COUNT = 20
CONFIDENCE = 0.9
ANTECEDENT = 3
LABEL = "label:block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(s, r"[0-9]+", "0")))
    extension = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("query:"), F.element_at(F.split(p, "="), 1)))
    none = F.array().cast("array<string>")
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(text, r"(?s)^(.*?)://", 1)))),
        suffixes,
        segments,
        F.when(extension != "", F.array(F.concat(F.lit("ext:"), extension))).otherwise(none),
        names,
        F.when(text.contains("#"), F.array(F.lit("fragment"))).otherwise(none),
    )
    return F.when(host == "", none).otherwise(F.array_distinct(found))


def mine(labelled: DataFrame, support: float = SUPPORT, least_count: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled(tokens, blocked) -> rules (rule_id, antecedent, key, confidence); key: the rarest token of the antecedent."""
    n, blocked = (int(x or 0) for x in labelled.agg(F.count("*"), F.sum(F.col("blocked").cast("int"))).first())
    spark = labelled.sparkSession
    schema = "rule_id bigint, antecedent array<string>, key string, confidence double"
    least = max(support, least_count / max(n, 1))
    if least > 1 or blocked < least_count:
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(minSupport=least, minConfidence=confidence, itemsCol="items").fit(settle(baskets))
    sets = model.freqItemsets
    with_label = sets.where(F.array_contains("items", LABEL) & F.size("items").between(2, ANTECEDENT + 1))
    with_label = with_label.select(F.array_sort(F.array_remove("items", LABEL)).alias("antecedent"), F.col("freq").alias("both"))
    alone = sets.where(~F.array_contains("items", LABEL) & (F.size("items") <= ANTECEDENT)).select(F.array_sort("items").alias("antecedent"), "freq")
    rules = settle(with_label.join(alone, "antecedent").select("antecedent", (F.col("both") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= confidence))
    single = sets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), F.col("freq").alias("often"))
    spread = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(single, "token")
    keyed = spread.groupBy("antecedent", "confidence").agg(F.min(F.struct("often", "token"))["token"].alias("key"))
    return settle(keyed.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "key", "confidence"))


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(row, tokens) -> (row, confidence) of the pages that a rule fits, by the inverted index on the rules' keys."""
    spread = pages.select("row", "tokens", F.explode("tokens").alias("key"))
    met = spread.join(rules.select("key", "antecedent", "confidence"), "key")
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("row").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", listed=LISTED, support: float = SUPPORT, least_count: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) of every row; confidence: the best mined rule's that fits, where no listed rule does."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = rows.select("row", "id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), rule.alias("rule"), verdict.alias("listed"))
    rows = settle(rows)
    rules = mine(rows.where(F.size("tokens") > 0).select("tokens", F.coalesce(F.col("listed") == "block", F.lit(False)).alias("blocked")), support, least_count, confidence)
    open_rows = rows.where("rule is null")
    mined = match(open_rows.select("row", "tokens"), rules)
    return rows.join(mined, "row", "left").select(
        "id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("confidence").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"), "confidence"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).withColumnRenamed("id", "page_id")
