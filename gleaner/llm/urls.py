"""URL rules: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
rule's. Each url is expanded into every host suffix with every path prefix that ends in a slash;
each rule is filed under its host and its path up to the last slash. Both are joined on the first
four bytes of a digest, then the full digests and the path are compared, and of the rules that fit
the longest wins (equal lengths: the longer host, then the text of the rule).

Expansion goes only as deep as the rules do, whose greatest numbers of labels and slashes are two
bounded numbers; this loses nothing. Rules are copied over a few salts, as some expressions (a top
domain) belong to a large share of all urls. Everything is DataFrame operations.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an
empty path fits no rule with a slash; rules of the same text count once, the one with the smallest
verdict; repeated rows give repeated results; no rules at all leave every url to the default.
Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.base import stored

DEFAULT = "allow"
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the registered query. Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules=tuple(RULES)) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path without query and fragment."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    place = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(place, r"^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(place, F.length(host) + 1, F.length(place))


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def filed_path(path: Column) -> Column:
    """A rule's path up to its last slash."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def suffixes(host: Column, labels: int) -> Column:
    """Host suffixes of at most ``labels`` labels; the deepest ones of a very long host."""
    parts = F.split(host, r"\.")
    most = F.least(F.size(parts), F.lit(labels))
    return F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def prefixes(path: Column, depth: int) -> Column:
    """Path prefixes that end in one of the first ``depth`` slashes, and the empty one."""
    upto = F.transform(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda n: F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))
    # past the last slash substring_index gives the whole path
    real = F.filter(upto, lambda p: F.startswith(path, p))
    return F.array_distinct(F.concat(F.array(F.lit("")), real if depth else F.array().cast("array<string>")))


def short_hash(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    filed = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule"))
    filed = filed.groupBy("host", "path", "rule").agg(F.min("verdict").alias("verdict"))
    filed = stored(filed.withColumn("digest", F.sha2(expression(F.col("host"), filed_path(F.col("path"))), 256)))
    depth = filed.agg(
        F.max(F.size(F.split("host", r"\."))), F.max(F.length("path") - F.length(F.translate("path", "/", "")))
    ).first()
    labels, slashes = depth[0] or 0, depth[1] or 0

    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    each = rows.where("host <> '' OR path <> ''").select("page_id", "host", "path", F.explode(suffixes(F.col("host"), labels)).alias("_suffix"))
    each = each.select("page_id", "host", "path", "_suffix", F.explode(prefixes(F.col("path"), slashes)).alias("_prefix"))
    each = each.withColumn("_digest", F.sha2(expression(F.col("_suffix"), F.col("_prefix")), 256))
    each = each.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))

    copies = filed.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "rule", "verdict", "digest",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy"),
    )
    same = (
        (short_hash(F.col("_digest")) == short_hash(F.col("digest")))
        & (F.col("_salt") == F.col("_copy"))
        & (F.col("_digest") == F.col("digest"))
        & (F.col("_suffix") == F.col("_host"))
        & F.startswith(F.col("path"), F.col("_path"))
    )
    order = F.struct(F.length("rule").alias("length"), F.length("_host").alias("host_length"), F.col("rule"), F.col("verdict"))
    best = each.join(copies, same).groupBy("page_id", "host", "path").agg(F.max(order).alias("best"))
    keys = ["page_id", "host", "path"]
    found = rows.alias("r").join(
        best.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys], "left"
    )
    return found.select(
        *[f"r.{c}" for c in keys],
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_row"),
    ).drop("_row")
