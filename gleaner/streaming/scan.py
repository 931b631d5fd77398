"""The incremental scan: one function from (batch, stored state) to flagged rows, used for batch
tables and for every micro-batch of a stream."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner import params as P
from gleaner.functions import dates as D
from gleaner.functions import money as M
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.operators import filters, identity, reports, scoring
from gleaner.operators.filters import exclude_with_reason
from gleaner.operators.keyed import flag_match, known_of, top_per_group
from gleaner.operators.state import alert_log_row, first_and_longest, longer_text
from gleaner.session import stored
from gleaner.sources.keyed_table import KeyedTable


@dataclass(frozen=True)
class ScanRules:
    exclude: P.ExcludeRules = field(default_factory=P.ExcludeRules)
    blend: P.BlendRules | None = None
    focus: P.FocusRules = field(default_factory=P.FocusRules)
    pay: P.PayRules = field(default_factory=P.PayRules)
    place: P.PlaceRules = field(default_factory=P.PlaceRules)
    threshold: float = 0.17


def enrich(df: DataFrame) -> DataFrame:
    """Skills, pay (only when both bounds are missing) and deadline (only when missing)."""
    out = df
    for name, kind in (("salary_min", "bigint"), ("salary_max", "bigint"), ("deadline", "date")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    no_pay = F.col("salary_min").isNull() & F.col("salary_max").isNull()
    out = out.withColumn("_pay", F.when(no_pay, M.salary_from_text(F.col("description"))))
    return out.withColumns(
        {
            "skills": X.skills(F.col("title"), F.col("description"), F.col("company")),
            "salary_min": F.coalesce("salary_min", "_pay.min"),
            "salary_max": F.coalesce("salary_max", "_pay.max"),
            "deadline": F.coalesce("deadline", D.extract_deadline(F.col("description"))),
        }
    ).drop("_pay")


@dataclass(frozen=True)
class Known:
    """What is stored already: given the keys of a batch, those that are known."""

    hashes: Callable[[DataFrame], DataFrame]
    ids: Callable[[DataFrame], DataFrame]

    @staticmethod
    def of(rows: DataFrame) -> Known:
        """From plain rows (id, job_hash)."""
        return Known(lambda keys: known_of(rows, keys, "job_hash"), lambda keys: known_of(rows, keys, "id"))


def scan_rows(batch: DataFrame, known: DataFrame | Known, query: DataFrame, rules: ScanRules) -> DataFrame:
    """Deduplicated rows of a batch with cross_duplicate, is_new, exclude_reason, score, notify.

    ``known`` has the stored (id, job_hash); ``query`` one (query_id, text) row. Only new rows
    that pass the exclusion rules are scored, against each other's term frequencies.
    """
    known = known if isinstance(known, Known) else Known.of(known)
    # duplicates go before the costly extraction; the result is read by every step below
    seen = stored(enrich(identity.dedup_keep_latest(identity.with_identity(batch))))
    narrow = stored(seen.select("arrival", "id", "job_hash"))
    unknown = identity.anti_known_hash(narrow, known.hashes(narrow))
    first = top_per_group(unknown, ["id"], [F.col("arrival").asc()])
    fresh = identity.anti_known_id(first, known.ids(narrow))
    flagged = flag_match(flag_match(seen, unknown, "arrival", "_unknown"), fresh, "arrival", "is_new")
    judged = flagged.withColumns(
        {
            "cross_duplicate": ~F.col("_unknown"),
            "exclude_reason": F.when(
                F.col("is_new"),
                R.exclude_reason(
                    F.col("title"), F.col("description"), F.col("company"), F.col("location"), rules.exclude
                ),
            ),
        }
    ).drop("_unknown")
    judged = stored(judged)
    to_score = F.col("is_new") & F.col("exclude_reason").isNull()
    hits = scoring.tfidf_cosine(
        judged.where(to_score).select("arrival", "description"), query, "arrival", "description"
    ).select("arrival", F.col("score").alias("_s"))
    based = judged.drop("score").join(hits, "arrival", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    scored = scoring.apply_boosts(
        based, "_s", rules.blend, rules.focus, rules.pay, rules.place, "_score"
    )
    # twelve digits: sums of doubles taken in another order then store the same number
    score = F.when(to_score, F.round("_score", 12)).when(F.col("exclude_reason").isNotNull(), F.lit(-1.0))
    return (
        scored.withColumn("score", score)
        .withColumn("notify", F.coalesce(F.col("score") >= rules.threshold, F.lit(False)))
        .drop("_s", "_score")
    )


STORED = "id string, job_hash string, arrival bigint, source string, title string, company string, location string, url string, description string, score double, exclude_reason string"
TEXTS = "id string, description string, arrival bigint"


@dataclass(frozen=True)
class ScanCounters:
    """What one scan did; every number is observed on the pass that writes the rows it counts."""

    seen: int = 0
    cross_duplicates: int = 0
    new: int = 0
    excluded: int = 0
    notified: int = 0
    sources: int = 0
    exported: int = 0
    tailored: int = 0
    alerted: int = 0
    errors: int = 0


@dataclass(frozen=True)
class ScanTail:
    """What a scan does with its new rows after scoring; steps that are None are left out.

    ``tailor`` builds documents for the rows that enter the best ``top_n`` and drops those it rejects.
    ``send`` gets the new rows that match ``alert`` if there are ``min_matches``, and says if it sent them.
    """

    export_from: float | None = None
    tailor: Callable[[DataFrame], DataFrame] | None = None
    top_n: int = 5
    alert: P.RecordFilter | None = None
    min_matches: int = 1
    send: Callable[[DataFrame], bool] | None = None


def observed(df: DataFrame, metrics: dict[str, F.Column]) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written and read again, with ``metrics`` counted on that one pass."""
    seen = Observation()
    out = stored(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]))
    return out, seen.get


def scan_once(batch: DataFrame, known: DataFrame | Known, query: DataFrame, rules: ScanRules, errors: int = 0) -> tuple[DataFrame, ScanCounters]:
    """The flagged rows of one scan and its counters; ``errors`` is the number of sources that failed."""
    rows, seen = observed(scan_rows(batch, known, query, rules), reports.scan_metrics())
    return rows, ScanCounters(**seen, errors=errors)


def longest_texts(texts: DataFrame) -> DataFrame:
    return first_and_longest(texts).select(*[c.split()[0] for c in TEXTS.split(", ")])


class ScanState:
    """Stored tables of the scan under one folder.

    Postings, hashes and later texts are keyed tables: a batch opens only the buckets its keys may be in,
    whatever its size. What a batch reports lies in folders by batch. A batch reads what earlier batches
    wrote and replaces its own results, so one that runs again after a failure gives the same tables.
    Choose ``buckets`` so that one bucket of postings fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.postings = KeyedTable(spark, f"{self.path}/postings", STORED, "id", buckets)
        self.hashes = KeyedTable(spark, f"{self.path}/hashes", "job_hash string", "job_hash", buckets)
        self.texts = KeyedTable(spark, f"{self.path}/texts", TEXTS, "id", buckets, longest_texts)

    def known(self, before: int) -> Known:
        return Known(lambda keys: self.hashes.known(keys, before), lambda keys: self.postings.known(keys, before))

    def write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch_id}")

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        if table in ("postings", "hashes", "texts"):
            return getattr(self, table).read(before)
        folder = f"{self.path}/{table}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(f"{schema}, batch bigint").parquet(folder)
        if before is not None:
            df = df.where(F.col("batch") < before)
        return df.drop("batch")

    def vacuum(self) -> None:
        for table in (self.postings, self.hashes, self.texts):
            table.vacuum()


COUNTERS = ", ".join(f"{f.name} bigint" for f in fields(ScanCounters)) + ", threshold double"
ALERT_LOG = "chunk bigint, matched_count bigint, jobs_alerted string, filter_used string"


def _due(state: ScanState, fresh: DataFrame, threshold: float, batch_id: int) -> DataFrame:
    """New rows at or above the threshold. Stored ones were told in their own batch, unless the
    threshold is lower than ever before: then their scores are read once more."""
    due = fresh.where(F.col("score") >= threshold)
    lowest = state.read("counters", COUNTERS, before=batch_id).agg(F.min("threshold")).first()[0]
    if lowest is not None and threshold < lowest:
        older = state.postings.read(batch_id)
        due = due.unionByName(older.where((F.col("score") >= threshold) & (F.col("score") < lowest)))
    return due


def _alert(state: ScanState, new: DataFrame, tail: ScanTail, batch_id: int) -> int:
    matched, n = observed(filters.record_filter(new, tail.alert), {"n": F.count("*")})
    sent = n["n"] >= max(tail.min_matches, 1) and (tail.send is None or tail.send(matched))
    log = alert_log_row(matched, json.dumps(asdict(tail.alert)), "id")
    state.write(log if sent else log.limit(0), "alert_log", batch_id)
    return n["n"] if sent else 0


def _tailor(state: ScanState, fresh: DataFrame, rules: ScanRules, tail: ScanTail, batch_id: int) -> int:
    """Documents for rows that enter the best ``top_n`` of all scans, which are carried from batch to batch."""
    names = [c.split()[0] for c in STORED.split(", ")]
    before = state.read("top", f"{STORED}, top_batch bigint", before=batch_id)
    before = before.where(F.col("top_batch") == before.agg(F.max("top_batch")).scalar()).select(*names)
    top = filters.top_suitable_n(before.unionByName(fresh.select(*names)), rules.threshold, tail.top_n)
    state.write(top.withColumn("top_batch", F.lit(batch_id).cast("bigint")), "top", batch_id)
    entered = state.read("top", f"{STORED}, top_batch bigint").where(F.col("top_batch") == batch_id)
    made, n = observed(tail.tailor(entered.join(before.select("id"), "id", "left_anti")), {"n": F.count("*")})
    state.write(made, "documents", batch_id)
    return n["n"]


def scan_micro_batch(
    state: ScanState,
    query: DataFrame,
    rules: ScanRules,
    sink: Callable[[DataFrame, int], None] | None = None,
    tail: ScanTail = ScanTail(),
    errors: Callable[[int], int] = lambda batch_id: 0,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch callback: scan, store new rows and longer texts, notify once, then the tail.

    The counters are written last: they say that the batch is done.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # written once, read by all that follows: one scoring per batch
        rows, counters = scan_once(batch, state.known(batch_id), query, rules, errors(batch_id))
        new = rows.where("is_new")
        fresh = new.select(*state.postings.columns)
        state.postings.append(fresh, batch_id)
        state.hashes.append(fresh.select("job_hash").where("job_hash <> ''"), batch_id)
        # texts of ids that were stored already, for the longest-description rule
        again = rows.where(~F.col("is_new") & ~F.col("cross_duplicate")).select("id", "description", "arrival")
        state.texts.append(longest_texts(again), batch_id)
        due, told = observed(_due(state, fresh, rules.threshold, batch_id), {"n": F.count("*")})
        state.write(due.select("id"), "notified", batch_id)
        if sink is not None:
            sink(due, batch_id)
        done = {"notified": told["n"]}
        if tail.export_from is not None:
            out, n = observed(fresh.where(F.col("score") >= tail.export_from), {"n": F.count("*")})
            state.write(out, "exported", batch_id)
            done["exported"] = n["n"]
        if tail.tailor is not None:
            done["tailored"] = _tailor(state, fresh, rules, tail, batch_id)
        if tail.alert is not None:
            done["alerted"] = _alert(state, new, tail, batch_id)
        row = {**asdict(counters), **done, "threshold": float(rules.threshold)}
        state.write(state.spark.createDataFrame([tuple(row.values())], COUNTERS), "counters", batch_id)
        state.vacuum()

    return run


def current_postings(state: ScanState) -> DataFrame:
    """Stored rows with the longest description any later sighting brought."""
    later = state.texts.read().select("id", F.col("description").alias("_text"))
    rows = state.postings.read().join(later, "id", "left")
    text = F.when(F.col("_text").isNull(), F.col("description")).otherwise(longer_text(F.col("description"), F.col("_text")))
    return rows.withColumn("description", text).drop("_text")


def run_stream(
    source: DataFrame,
    callback: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Micro-batches never overlap. Without ``every`` all available rows are scanned, then it ends."""
    writer = source.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_periodically(
    source: DataFrame,
    callback: Callable[[DataFrame, int], None],
    checkpoint: str,
    pause: float,
    rounds: int | None = None,
    wait: Callable[[float], None] = time.sleep,
) -> None:
    """Scan all available rows, wait ``pause`` seconds in full after the scan has ended, and again.

    A processing-time trigger keeps a rate instead: after a slow batch it starts at once.
    """
    done = 0
    while rounds is None or done < rounds:
        run_stream(source, callback, checkpoint).awaitTermination()
        done += 1
        if done != rounds:
            wait(pause)


def rescore(postings: DataFrame, query: DataFrame, rules: ScanRules) -> DataFrame:
    """``postings`` with exclude_reason and score found anew, against the rows that are not excluded."""
    pay = M.salary_from_text(F.col("description"))
    kept = exclude_with_reason(postings, rules.exclude)
    kept = kept.withColumn("_pay", pay).withColumns({"salary_min": F.col("_pay.min"), "salary_max": F.col("_pay.max")})
    ok = F.col("exclude_reason").isNull()
    hits = scoring.tfidf_cosine(kept.where(ok).select("arrival", "description"), query, "arrival", "description")
    hits = hits.select("arrival", F.col("score").alias("_s"))
    based = kept.drop("score", "_pay").join(hits, "arrival", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    out = scoring.apply_boosts(based, "_s", rules.blend, rules.focus, rules.pay, rules.place)
    return out.withColumn("score", F.when(ok, F.col("score")).otherwise(F.lit(-1.0))).drop("_s")
