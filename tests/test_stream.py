"""A stream over split files ends in the same tables as the batch functions."""

from pyspark.sql import functions as F

from gleaner.plans.cases_state import SCAN
from gleaner.streaming import scan

SCHEMA = "arrival long, source string, url string, title string, company string, location string, description string, posted_at string, first_seen timestamp"


def rows(numbers):
    from datetime import datetime

    return [
        (i, f"b{i % 2}", f"https://x.org/{i % 7 if i < 20 else i}", f"Data clerk {i % 5}", f"Firm {i % 6}", "Guelph, ON", "python data " + "lab " * (i % 9), None, datetime(2026, 1, 1))
        for i in numbers
    ]


def test_micro_batches_equal_successive_scans(spark, tmp_path):
    src, query = str(tmp_path / "in"), spark.createDataFrame([(0, "python data lab")], "query_id int, text string")
    batches = [range(0, 15), range(15, 30), range(30, 40)]
    for b in batches:
        spark.createDataFrame(rows(b), SCHEMA).coalesce(1).write.mode("append").parquet(src)
    state = scan.ScanState(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    sent = []
    run = scan.scan_micro_batch(state, query, SCAN, lambda df, i: sent.extend((i, r["id"]) for r in df.collect()))
    scan.run_stream(stream, run, str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: (r["arrival"], r["exclude_reason"], round(r["score"], 9)) for r in state.read("postings", scan.STORED).collect()}

    known = spark.createDataFrame([], "id string, job_hash string")
    want = {}
    for b in batches:
        out = scan.scan_rows(spark.createDataFrame(rows(b), SCHEMA), known, query, SCAN).where("is_new")
        kept = out.select("id", "job_hash", "arrival", "exclude_reason", "score").collect()
        want |= {r["id"]: (r["arrival"], r["exclude_reason"], round(r["score"], 9)) for r in kept}
        known = known.unionByName(spark.createDataFrame([(r["id"], r["job_hash"]) for r in kept], "id string, job_hash string"))
    assert got == want
    # everything above the threshold was sent exactly once
    due = {r["id"] for r in state.read("postings", scan.STORED).where(F.col("score") >= SCAN.threshold).collect()}
    assert sorted(i for _, i in sent) == sorted(due)


def test_rerun_of_a_batch_changes_nothing(spark, tmp_path):
    query = spark.createDataFrame([(0, "python data lab")], "query_id int, text string")
    state = scan.ScanState(spark, str(tmp_path / "state"))
    run = scan.scan_micro_batch(state, query, SCAN)
    first, second = (spark.createDataFrame(rows(b), SCHEMA) for b in (range(10), range(10, 25)))
    run(first, 0)
    run(second, 1)
    before = sorted(map(str, scan.current_postings(state).collect()))
    run(second, 1)
    assert sorted(map(str, scan.current_postings(state).collect())) == before


def test_longer_text_of_known_id_is_kept(spark, tmp_path):
    query = spark.createDataFrame([(0, "python")], "query_id int, text string")
    state = scan.ScanState(spark, str(tmp_path / "state"))
    run = scan.scan_micro_batch(state, query, SCAN)
    row = rows([1])[0]
    run(spark.createDataFrame([row], SCHEMA), 0)
    longer = (2, row[1], row[2], "Other title", *row[4:6], row[6] + " and much more", *row[7:])
    run(spark.createDataFrame([longer], SCHEMA), 1)
    out = scan.current_postings(state).collect()
    assert len(out) == 1 and out[0]["title"] == row[3] and out[0]["description"].endswith("much more")


def test_status_stream_equals_batch(spark):
    from gleaner.plans.catalog import QUERIES

    stream, batch = (
        sorted(map(str, QUERIES[n](spark, "/root/testdata/sf0.001").collect()))
        for n in ("status_updates_stream", "status_updates")
    )
    assert stream == batch


def test_waits_in_full_after_each_scan(spark, tmp_path):
    source = spark.readStream.schema("event_id long").parquet("/root/testdata/sf0.001/events.parquet*")
    told = []
    scan.run_periodically(
        source, lambda batch, i: told.append(("scan", i)), str(tmp_path / "c"), 7.5, rounds=3, wait=lambda s: told.append(("wait", s))
    )
    assert told == [("scan", 0), ("wait", 7.5), ("wait", 7.5)]


def test_history_is_not_shuffled(spark, tmp_path):
    from gleaner.operators.keyed import known_of
    from gleaner.session import stored

    path = str(tmp_path / "history")
    spark.range(100_000).selectExpr("cast(id as string) AS job_hash", "repeat('x', 50) AS title").write.parquet(path)
    batch = stored(spark.range(5).selectExpr("cast(id * 3 as string) AS job_hash"))
    hits = known_of(spark.read.parquet(path), batch, "job_hash")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and hits.count() == 5


def test_tail_and_counters_are_the_scans_own(spark, tmp_path):
    from gleaner import params as P

    query = spark.createDataFrame([(0, "python data lab")], "query_id int, text string")
    state = scan.ScanState(spark, str(tmp_path / "state"), buckets=4)
    sent, told = [], []

    def send(df):
        sent.append(sorted(r["id"] for r in df.collect()))
        return len(sent) < 3

    tail = scan.ScanTail(
        export_from=0.4, tailor=lambda df: df.where("title <> 'Data clerk 3'").select("id", F.concat(F.lit("for "), "title").alias("resume")),
        top_n=4, alert=P.RecordFilter(excluded_keywords=["clerk 4"]), min_matches=2, send=send,
    )
    run = scan.scan_micro_batch(state, query, SCAN, lambda df, i: told.append((i, df.count())), tail, lambda i: i)
    everything, top = [], []
    for b, numbers in enumerate([range(0, 20), range(20, 40), range(40, 60)]):
        batch = spark.createDataFrame(rows(numbers), SCHEMA)
        run(batch, b)
        if b == 1:  # the batch runs again, as after a failure
            sent.pop()
            run(batch, b)
        stored = state.postings.read(b + 1).join(state.postings.read(b).select("id"), "id", "left_anti").collect()
        everything += stored
        n = state.read("counters", f"{scan.COUNTERS}").collect()
        assert len(n) == b + 1
        n = next(r for r in n if r["errors"] == b)
        assert n["seen"] == n["cross_duplicates"] + n["new"] + (n["seen"] - n["cross_duplicates"] - n["new"]) and n["sources"] == 2
        assert n["new"] == len(stored) and n["excluded"] == sum(r["exclude_reason"] is not None for r in stored)
        assert n["notified"] == sum(r["score"] >= SCAN.threshold for r in stored) and told[-1] == (b, n["notified"])
        assert n["exported"] == sum(r["score"] >= 0.4 for r in stored)
        matching = sorted(r["id"] for r in stored if "clerk 4" not in r["title"])
        assert sent[b] == matching and n["alerted"] == (len(matching) if b < 2 else 0)
        best = sorted((r for r in everything if r["score"] >= SCAN.threshold), key=lambda r: (-r["score"], r["arrival"]))[:4]
        entered = [r for r in best if r["id"] not in top]
        top = [r["id"] for r in best]
        assert n["tailored"] == sum(r["title"] != "Data clerk 3" for r in entered)
    log = state.read("alert_log", scan.ALERT_LOG).collect()
    assert [r["matched_count"] for r in log] and len(log) == 2
    assert state.read("documents", "id string, resume string").count() > 0


def test_a_lower_threshold_tells_stored_rows_once(spark, tmp_path):
    from dataclasses import replace

    query = spark.createDataFrame([(0, "python data lab")], "query_id int, text string")
    state, sent = scan.ScanState(spark, str(tmp_path / "state"), buckets=4), []
    batches = [range(0, 12), range(12, 24), range(24, 36)]
    for b, (numbers, threshold) in enumerate(zip(batches, (0.9, 0.1, 0.5), strict=True)):
        rules = replace(SCAN, threshold=threshold)
        run = scan.scan_micro_batch(state, query, rules, lambda df, i: sent.extend(r["id"] for r in df.collect()))
        run(spark.createDataFrame(rows(numbers), SCHEMA), b)
    first_two = {r["id"] for r in state.postings.read(2).where("score >= 0.1").collect()}
    last = {r["id"] for r in state.postings.read().join(state.postings.read(2).select("id"), "id", "left_anti").where("score >= 0.5").collect()}
    assert sorted(sent) == sorted(first_two | last) and first_two


def test_scan_opens_stored_buckets_only(spark, tmp_path):
    """With broadcasts off, no stored row is moved, however large the batch."""
    query = spark.createDataFrame([(0, "python data lab")], "query_id int, text string")
    state = scan.ScanState(spark, str(tmp_path / "state"), buckets=4)
    run = scan.scan_micro_batch(state, query, SCAN)
    run(spark.createDataFrame(rows(range(60)), SCHEMA), 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = state.postings.read().select("id")
        plan = state.known(1).ids(keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
