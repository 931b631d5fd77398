"""Identity, duplicates and what is already known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import text as X
from gleaner.operators.keyed import anti_join, flag_match, top_per_group
from gleaner.session import stored


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "id": X.posting_id(F.col("source"), F.col("url")),
            "job_hash": X.content_hash(F.col("title"), F.col("company"), F.col("location")),
        }
    )


def dedup_keep_latest(df: DataFrame, key: str = "job_hash", arrival: str = "arrival") -> DataFrame:
    """One row per content key: latest posted_at by string order, then the first arrival."""
    posted = F.when(F.col("posted_at") != "", F.col("posted_at"))
    return top_per_group(df, [key], [posted.desc_nulls_last(), F.col(arrival).asc()])


def dedup_queue(df: DataFrame, score: Column, tie: Sequence[Column]) -> DataFrame:
    """One row per (title, company), the best combined score."""
    keys = {
        "_title": F.lower(F.trim(X.text_of(F.col("title")))),
        "_company": F.lower(F.trim(X.text_of(F.col("company")))),
    }
    out = top_per_group(df.withColumns(keys), list(keys), [score.desc_nulls_last(), *tie])
    return out.drop(*keys)


def anti_known_hash(
    batch: DataFrame, known: DataFrame, key: str = "job_hash", arrival: str = "arrival"
) -> DataFrame:
    """Rows whose hash is not stored, the first arrival per hash; an empty hash always passes."""
    own = F.concat(F.lit("row:"), F.col(arrival).cast("string"))
    keyed = batch.withColumn(
        "_key", F.when(X.text_of(F.col(key)) == "", own).otherwise(F.col(key))
    )
    # one row per hash first: the anti join then sees no hot key
    first = top_per_group(keyed, ["_key"], [F.col(arrival).asc()])
    stored = known.where(F.col(key) != "").select(F.col(key).alias("_key"))
    return anti_join(first, stored, "_key").drop("_key")


def flag_new(batch: DataFrame, known: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """is_new per row: id not stored and first of its id in this batch."""
    first = top_per_group(batch.select(key, arrival), [key], [F.col(arrival).asc()])
    fresh = anti_join(first, known, key)
    return flag_match(batch, fresh, arrival, "is_new")


def anti_known_id(batch: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return anti_join(batch, known, key)


def distinct_hashes(df: DataFrame, key: str = "job_hash") -> DataFrame:
    return df.select(key).where(F.col(key) != "").distinct()


def cap_per_source(
    df: DataFrame, listings: int, enriched: int, order: Sequence[str] = ("page", "pos")
) -> DataFrame:
    """First sighting of a URL inside its source, then the first ``listings`` of every source."""
    order_by = [F.col(c).asc() for c in order]
    first = top_per_group(df, ["source", "url"], order_by)
    kept = top_per_group(first, ["source"], order_by, listings, rank="listing")
    return kept.withColumn("enrich", F.col("listing") <= enriched)


def ordered_distinct_terms(df: DataFrame, term: str, position: str, cap: int | None = None) -> DataFrame:
    """Distinct trimmed terms without regard to case: first spelling, first position, capped."""
    spelled = df.select(F.trim(F.col(term)).alias("term"), F.col(position).alias("position"))
    spelled = spelled.where(F.col("term") != "")
    first = top_per_group(spelled, [F.lower("term")], [F.col("position").asc()])
    return first if cap is None else first.orderBy("position").limit(cap)


def hash_registry(df: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """First sighting of every hash with its source and date, and the last alert on it."""
    first = (
        df.where(F.col("job_hash") != "")
        .groupBy("job_hash")
        .agg(F.min(F.struct("arrival", "source", "posted_at", "first_seen")).alias("_first"))
        .select("job_hash", "_first.source", "_first.posted_at", "_first.first_seen")
    )
    if alerts is None:
        return first.withColumn("last_alert", F.lit(None).cast("timestamp"))
    last = alerts.groupBy("job_hash").agg(F.max("sent_at").alias("last_alert"))
    return first.join(last, "job_hash", "left")


# Keys that are no whole id need so many characters.
LEAST_PREFIX = 4


def lookup_by_prefix(df: DataFrame, keys: DataFrame, key: str = "lookup") -> DataFrame:
    """Exact id, else a prefix of four or more characters that only one id has.

    The first four characters say which ids a key can mean. Only ids that share them with a key go on, each cut to
    the lengths that keys of its own beginning have, so the table of ids is scanned once and hardly moved
    where the keys are few.
    """
    wanted = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    start = F.substring(key, 1, LEAST_PREFIX).alias("_start")
    asked = wanted.where(F.length(key) >= LEAST_PREFIX).groupBy(start).agg(F.collect_set(F.length(key)).alias("_lengths"))
    short = wanted.where(F.length(key) < LEAST_PREFIX)
    found = df.select("id", F.substring("id", 1, LEAST_PREFIX).alias("_start")).join(stored(asked), "_start")
    fitting = F.filter("_lengths", lambda n: n <= F.length("id"))
    prefixes = found.select("id", F.explode_outer(fitting).alias("_n")).select("id", F.substring("id", F.lit(1), F.col("_n")).alias(key))
    # counted before the join: a prefix that many ids share is one row by then
    counted = prefixes.groupBy(key).agg(F.min("id").alias("_least"), F.max("id").alias("_most"))
    whole = F.col("_least") == F.col(key)  # an id is the least of all that begin with it
    one = counted.where(whole | (F.col("_least") == F.col("_most"))).select(key, F.col("_least").alias("id"))
    exact_short = short.join(df.select("id").distinct(), F.col(key) == F.col("id")).select(key, "id")
    return wanted.join(one, key).select(key, "id").unionByName(exact_short)


def label_texts(df: DataFrame, path: str = "path", text: str = "text", arrival: str = "arrival") -> DataFrame:
    """Label per text file: the stem; later files of the same stem add their folder."""
    named = df.withColumns(
        {
            "_stem": F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1),
            "_parent": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
            text: F.regexp_replace(text, "^﻿", ""),
        }
    )
    first = top_per_group(named.select(arrival, "_stem"), ["_stem"], [F.col(arrival).asc()])
    return (
        flag_match(named, first, arrival, "_first")
        .withColumn(
            "label",
            F.when(F.col("_first"), F.col("_stem")).otherwise(
                F.concat("_stem", F.lit(" ("), "_parent", F.lit(")"))
            ),
        )
        .drop("_stem", "_parent", "_first")
    )
