"""JSON responses of search APIs, flat feeds and paged posting services as rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.session import ensure_checkpoint_dir, stored


def _string(v: Column, path: str) -> Column:
    """The value at the path if it is a JSON string, else null.

    Of the values that JSON has, only a string can be read as bytes; so this is one look-up and its type needs no other.
    Look-ups are what reading a body costs: entries below are first turned into the texts that decide on them.
    """
    return F.try_variant_get(v, path, "binary").cast("string")


def _array(body: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(body), path, "array<variant>")


def ingest_results(responses: DataFrame, body: str = "body") -> DataFrame:
    """Search API: one row per entry of results[] that has a string title and url."""
    def titled(e: Column) -> Column:
        return F.struct(_string(e, "$.title").alias("title"), e.alias("entry"))

    def linked(r: Column) -> Column:
        url = F.when(r["title"] != "", _string(r["entry"], "$.redirect_url"))
        return F.struct(r["title"].alias("title"), url.alias("url"), r["entry"].alias("entry"))

    e = F.col("_e.entry")
    entries = F.transform(F.transform(_array(F.col(body), "$.results"), titled), linked)
    out = responses.select(*[c for c in responses.columns if c != body], F.posexplode(entries).alias("pos", "_e"))
    rows = out.where((F.col("_e.title") != "") & (F.col("_e.url") != "")).select(
        *[c for c in out.columns if c != "_e"],
        F.col("_e.title").alias("title"),
        F.col("_e.url").alias("_url"),
        X.text_of(_string(e, "$.description")).alias("description"),
        X.text_of(_string(e, "$.company.display_name")).alias("company"),
        X.text_of(_string(e, "$.location.display_name")).alias("location"),
        _string(e, "$.created").alias("posted_at"),
    )
    return rows.withColumn("url", X.canonical_search_url(F.col("_url"))).drop("_url")


def ingest_feed(responses: DataFrame, body: str = "body", limit: int | None = None) -> DataFrame:
    """Flat feed: element 0 is metadata; all acceptable entries of each body, or the first ``limit``."""

    def named(e: Column) -> Column:
        return F.struct(_string(e, "$.position").alias("title"), _string(e, "$.url").alias("url"), e.alias("entry"))

    def wanted(r: Column) -> Column:
        e = r["entry"]
        # a text of "0" is an id, a number 0 is none
        has_id = ~F.try_variant_get(e, "$.id", "string").isin("", "0", "false") | (_string(e, "$.id") != "")
        return has_id & R.location_allowed(_string(e, "$.location"))

    entries = F.transform(F.slice(_array(F.col(body), "$"), 2, 2_000_000_000), named)
    kept = F.filter(F.filter(entries, lambda r: (r["title"] != "") & (r["url"] != "")), wanted)
    kept = F.slice(kept, 1, limit) if limit else kept
    e = F.col("_e.entry")
    return responses.select(
        *[c for c in responses.columns if c != body], F.posexplode(kept).alias("pos", "_e")
    ).select(
        *[c for c in responses.columns if c != body],
        "pos",
        F.col("_e.title").alias("title"),
        F.col("_e.url").alias("url"),
        X.snippet_text(_string(e, "$.description")).alias("description"),
        X.text_of(_string(e, "$.company")).alias("company"),
        X.text_of(_string(e, "$.location")).alias("location"),
        _string(e, "$.date").alias("posted_at"),
    )


def ingest_postings(responses: DataFrame, base_url: str, company: str, body: str = "body") -> DataFrame:
    """Paged postings: rows with a rooted path and a title; ``more`` = another page is worth it."""
    j = F.try_parse_json(F.col(body))
    postings = F.try_variant_get(j, "$.jobPostings", "array<variant>")
    total = F.try_variant_get(j, "$.total", "bigint")
    others = [c for c in responses.columns if c != body]
    staged = responses.select(
        *others,
        postings.alias("_p"),
        ((F.size(postings) > 0) & (total.isNull() | (F.col("offset") + F.size(postings) < total))).alias("more"),
    )
    # outer, or the parsing would be done again to skip empty pages; their rows without entry go below
    out = staged.select(*others, "more", F.posexplode_outer("_p").alias("pos", "_e"))
    e = F.col("_e")
    title = X.strip(_string(e, "$.title"))
    location = X.strip(X.text_of(_string(e, "$.locationsText")))
    path = _string(e, "$.externalPath")
    return out.select(
        *others,
        "more",
        "pos",
        F.concat(F.lit(base_url), path).alias("url"),
        title.alias("title"),
        F.lit(company).alias("company"),
        location.alias("location"),
        F.concat_ws(" — ", title, F.when(location != "", location)).alias("description"),
        _string(e, "$.postedOn").alias("posted_at"),
    ).where(path.startswith("/") & _string(e, "$.title").rlike(r"(?U)\S"))


def unreadable_bodies(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses whose body is no JSON, with an ``error``; they yield no entries elsewhere."""
    bad = F.col(body).isNotNull() & F.try_parse_json(F.col(body)).isNull()
    others = [c for c in responses.columns if c != body]
    return responses.where(bad).select(*others, F.lit("body is not JSON").alias("error"))


def union_sources(parsed: Sequence[DataFrame]) -> DataFrame:
    """All sources in one frame; columns a source lacks become null."""
    out = parsed[0]
    for df in parsed[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def source_errors(parsed: DataFrame, error: str = "_error") -> DataFrame:
    """Rows and failures per source; a failing source does not stop the others."""
    return parsed.groupBy("source").agg(
        F.count("*").alias("records"), F.count_if(F.col(error).isNotNull()).alias("errors")
    )


@dataclass(frozen=True)
class Gathered:
    """``rows`` of all sources that could be read, with their ``source``; ``failed`` is (source, error)."""

    rows: DataFrame
    failed: DataFrame


def gather_sources(spark: SparkSession, readers: Mapping[str, Callable[[SparkSession], DataFrame]], at_once: int = 4) -> Gathered:
    """Reads every source to its end, some ``at_once``; one that fails becomes an error row and stops no other.

    A source fails when its rows are read, not when its frame is built, so each one's rows are written here:
    a corrupt file or a rule that raises counts against its own source only, and none of its rows are kept.
    """

    def read(name: str) -> tuple[str, DataFrame | None, str | None]:
        try:
            return name, stored(readers[name](spark).withColumn("source", F.lit(name))), None
        except Exception as e:  # noqa: BLE001 -- whatever a source raises is its own failure
            return name, None, f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"

    ensure_checkpoint_dir(spark)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = list(pool.map(read, readers))
    good = [df for _, df, _ in done if df is not None]
    rows = union_sources(good) if good else spark.createDataFrame([], "source string")
    failed = spark.createDataFrame([(n, e) for n, _, e in done if e is not None], "source string, error string")
    return Gathered(rows, failed)


def gathered_counts(gathered: Gathered) -> DataFrame:
    """(source, records, errors) of every source that was asked, failed ones included."""
    both = gathered.rows.select("source", F.lit(None).cast("string").alias("error")).unionByName(gathered.failed)
    return both.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"))


# A host's rules are copied so often where they are joined, and its links first ranked in so many parts.
HOST_PARTS = 16


def forbidden_paths(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) of the links whose longest fitting rule forbids them.

    ``rules`` is (host, prefix) with an optional boolean ``allow``, false if there is none; of equally long
    rules one that allows wins. A path is expanded to its prefixes of the lengths that its host's rules have, so
    rules are found by equal keys, and a host with very many links is dealt over copies of its rules.
    """
    if "allow" not in rules.columns:
        rules = rules.withColumn("allow", F.lit(False))
    rules = rules.select("host", "prefix", "allow").distinct()
    parts = F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))).alias("_part")
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_lengths")).select("host", "_lengths", parts)
    paths = links.select("host", "path").distinct()
    paths = paths.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(HOST_PARTS)).cast("int"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("path"))
    prefixes = paths.join(lengths, ["host", "_part"]).select("host", "path", "_part", F.explode_outer(fitting).alias("_n"))
    prefixes = prefixes.withColumn("prefix", F.substring("path", F.lit(1), F.col("_n")))
    met = prefixes.join(rules.select("*", parts), ["host", "prefix", "_part"])
    longest = met.groupBy("host", "path").agg(F.max(F.struct("_n", "allow")).alias("_rule"))
    return longest.where(~F.col("_rule.allow")).select("host", "path")


def crawl_frontier(
    links: DataFrame, known: DataFrame, disallowed: DataFrame, per_host: int, seconds: float, ties: Sequence[str] = ()
) -> DataFrame:
    """Detail URLs still to fetch with a start offset per host.

    Known ids go first, then paths a robots rule forbids; the cap keeps the first ``per_host``
    urls of every host, and their rank gives the slot; ``ties`` are the columns that order equal urls, so that reruns
    agree. A host is ranked in parts first, so that one with very many
    links sends ``per_host`` of each part to its last ranking.
    """
    from gleaner.operators.keyed import anti_join, top_per_group

    staged = links.withColumns(
        {
            "host": X.host_of(F.col("url")),
            "path": F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1),
        }
    )
    fresh = anti_join(staged, known, "url")
    allowed = anti_join(fresh, forbidden_paths(fresh, disallowed), ["host", "path"])
    part = F.pmod(F.xxhash64("url"), F.lit(HOST_PARTS))
    order = [F.col(c).asc() for c in ("url", *ties)]
    first = top_per_group(allowed.withColumn("_part", part), ["host", "_part"], order, per_host).drop("_part")
    ranked = top_per_group(first, ["host"], order, per_host, rank="slot")
    return ranked.withColumn("start_after", (F.col("slot") - 1) * F.lit(float(seconds)))
