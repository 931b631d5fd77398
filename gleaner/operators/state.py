"""Operators that fold new rows into stored tables. All of them aggregate before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import rules as R
from gleaner.operators.keyed import anti_join


def first_and_longest(batch: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """One row per key of a batch: the first arrival, with the longest description."""
    columns = [c for c in batch.columns if c != key]
    longest = F.min_by(F.struct("description"), F.struct(F.coalesce(-F.length("description"), F.lit(1)).alias("n"), F.col(arrival)))
    folded = batch.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(arrival)).alias("_row"), longest.alias("_text"))
    return folded.select(*[
        F.col(key) if c == key else F.col("_text.description" if c == "description" else f"_row.{c}").alias(c) for c in batch.columns
    ])


def longer_text(old: Column, new: Column) -> Column:
    """The stored description unless a strictly longer one has come."""
    return F.when(F.coalesce(F.length(new) > F.length(old), old.isNull()), new).otherwise(old)


def keep_longest(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a full outer join of stored rows (struct ``old``) with a batch's (struct ``new``): a stored row
    stays and takes a strictly longer description, a new one is inserted as it is."""
    stored = F.col("old").isNotNull()
    given = joined.schema["new"].dataType.names

    def pick(c: str) -> Column:
        new = F.col(f"new.{c}") if c in given else F.lit(None)
        if c == "description":
            return F.when(stored, longer_text(F.col("old.description"), new)).otherwise(new).alias(c)
        return F.when(stored, F.col(f"old.{c}")).otherwise(new).alias(c)

    return joined.select(*[pick(c) for c in columns], (~stored).alias("is_new"))


def upsert_longest(state: DataFrame, batch: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """Insert new keys; a known key keeps its stored row but takes a strictly longer description.

    The batch is folded to one row per key, map-side first, and met with the state in one full outer
    join, so the state is read once. A state that is bucketed by the key is not shuffled
    (``sources.keyed_table`` keeps such tables and rewrites the touched buckets only).
    """
    old = state.select(F.col(key).alias("_old"), F.struct(*state.columns).alias("old"))
    folded = first_and_longest(batch, key, arrival)
    new = folded.select(F.col(key).alias("_new"), F.struct(*folded.columns).alias("new"))
    return keep_longest(old.join(new, F.col("_old") == F.col("_new"), "full"), state.columns)


def reject_statuses(events: DataFrame) -> DataFrame:
    return events.where(F.col("status").isNotNull() & ~F.col("status").isin(P.STATUSES))


def status_updates(events: DataFrame, key: str = "posting_id") -> DataFrame:
    """Status, applied_at and notes per posting after all its events.

    A null status clears everything, 'applied' stamps the time, other statuses keep it, null
    notes keep the old ones. One pass of max/max_by, so a hot posting folds map-side.
    """
    pos = F.struct(F.col("ts"), F.col("event_id"))
    valid = events.where(F.col("status").isNull() | F.col("status").isin(P.STATUSES))
    is_set = F.col("status").isNotNull()
    folded = valid.groupBy(key).agg(
        F.max(F.when(~is_set, pos)).alias("_cleared"),
        F.max(F.struct(pos.alias("p"), F.col("status"))).alias("_last"),
        F.max(F.when(F.col("status") == "applied", pos)).alias("_applied"),
        F.max(F.when(is_set & F.col("notes").isNotNull(), F.struct(pos.alias("p"), F.col("notes")))).alias("_noted"),
    )

    def after_clear(p: Column) -> Column:
        return F.col("_cleared").isNull() | (p > F.col("_cleared"))

    return folded.select(
        key,
        F.col("_last.status").alias("application_status"),
        F.when(after_clear(F.col("_applied")), F.col("_applied.ts")).alias("applied_at"),
        F.when(after_clear(F.col("_noted.p")), F.col("_noted.notes")).alias("application_notes"),
    )


def score_updates(df: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = "arrival", seq: str = "seq") -> DataFrame:
    """Bulk replacement by key: the newest non-null value wins, else the stored one stays."""
    newest = updates.groupBy(key).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_new_{c}")
            for c in columns
        ]
    )
    out = df.join(newest, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(
        *[f"_new_{c}" for c in columns]
    )


def notify_once(df: DataFrame, threshold: float, notified: DataFrame, key: str = "arrival") -> DataFrame:
    return anti_join(df.where(F.col("score") >= threshold), notified, key)


def alert_when_min(matched: DataFrame, minimum: int) -> DataFrame:
    """All matched rows if there are at least ``minimum`` of them, else none."""
    n = matched.agg(F.count("*").alias("n")).scalar()
    return matched.where(n >= minimum)


def alert_log_row(matched: DataFrame, filter_json: str, key: str = "arrival", chunk: int | None = None) -> DataFrame:
    """The log row of an alert batch: the total, and all ids as JSON.

    ``chunk`` asks for several rows of about so many ids each, for alerts too large for one row.
    """
    parts = F.lit(1) if chunk is None else F.greatest(F.ceil(matched.agg(F.count("*")).scalar() / F.lit(chunk)), F.lit(1))
    part = F.pmod(F.xxhash64(key), parts.cast("bigint"))
    logged = matched.groupBy(part.alias("chunk")).agg(F.sort_array(F.collect_list(key)).alias("_ids"), F.count("*").alias("_n"))
    total = F.col("_n") if chunk is None else matched.agg(F.count("*")).scalar()
    return logged.select("chunk", total.cast("bigint").alias("matched_count"), F.to_json("_ids").alias("jobs_alerted"), F.lit(filter_json).alias("filter_used"))


def send_alert(matched: DataFrame, send: Callable[[DataFrame], bool], filter_json: str, key: str = "arrival") -> DataFrame:
    """Hand the matched rows to a sender, and return the log rows of what was sent: none if it refused."""
    log = alert_log_row(matched, filter_json, key)
    return log if send(matched) else log.where("false")


def applications(statuses: DataFrame) -> DataFrame:
    """Folded status rows that have a status, with what an overview shows of them."""
    return statuses.where(F.col("application_status").isNotNull())


def alert_join_back(log: DataFrame, postings: DataFrame, key: str = "arrival") -> DataFrame:
    ids = log.select(
        "alert_id", F.explode(F.from_json("jobs_alerted", "array<bigint>")).alias(key)
    )
    return ids.join(postings, key)


def cache_lookup(df: DataFrame, cache: DataFrame, keys: Sequence[str] = ("job_id", "master_hash")) -> DataFrame:
    """Report per (record, version), null when not cached; the newest entry of a key counts."""
    newest = cache.groupBy(*keys).agg(F.max_by("report_json", "created_at").alias("report_json"))
    return df.join(newest, list(keys), "left").withColumn("hit", F.col("report_json").isNotNull())


def suitability_backfill(df: DataFrame, results: DataFrame, key: str = "arrival") -> DataFrame:
    """Rows with both score and verdict stay; others take a fresh result, or keep what they had."""
    fresh = results.select(
        key, F.col("suitability_score").alias("_s"), F.col("qualification_verdict").alias("_v")
    )
    cached = F.col("suitability_score").isNotNull() & F.col("qualification_verdict").isNotNull()
    take = ~cached & F.col("_s").isNotNull()
    return (
        df.join(fresh, key, "left")
        .withColumn("recomputed", take)
        .withColumns(
            {
                "suitability_score": F.when(take, F.col("_s")).otherwise(F.col("suitability_score")),
                "qualification_verdict": F.when(take, F.col("_v")).otherwise(F.col("qualification_verdict")),
            }
        )
        .drop("_s", "_v")
    )


def apply_verdicts(queue: DataFrame, verdicts: DataFrame, gate: str = "none", key: str = "arrival") -> DataFrame:
    """Outcome of a liveness check per queue row.

    Dead rows are hidden; a longer page text replaces the description and is judged again; rows
    without a verdict stay as unverified.
    """
    j = queue.join(
        verdicts.select(key, F.col("state").alias("_state"), F.col("full_text").alias("_full")), key, "left"
    )
    state = F.coalesce("_state", F.lit("unchecked"))
    longer = F.coalesce(
        (state != "dead") & (F.length("_full") > F.length(F.coalesce("description", F.lit("")))), F.lit(False)
    )
    staged = j.withColumns(
        {
            "description": F.when(longer, F.col("_full")).otherwise(F.col("description")),
            "enriched": longer,
            "_state": state,
        }
    )
    reason = F.when(
        F.col("enriched"),
        R.unsuitable_reason(F.col("title"), F.col("description"), F.col("company"), F.col("location"), gate),
    )
    out = staged.withColumn("_reason", reason)
    return out.withColumns(
        {
            "hidden": (F.col("_state") == "dead") | F.col("_reason").isNotNull(),
            "hidden_reason": F.when(F.col("_state") == "dead", F.lit("dead")).otherwise(F.col("_reason")),
            "confidence": F.when(F.col("_state") == "live", F.lit("live")).otherwise(F.lit("unverified")),
        }
    ).drop("_state", "_full", "_reason")
