"""Keyed tables: only touched buckets are read or written, and a batch that fails or runs again changes nothing."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import state
from gleaner.sources.keyed_table import KeyedTable

ROWS = "id string, arrival long, title string, description string"


def table(spark, path, **more):
    return KeyedTable(spark, str(path), ROWS, "id", 8, **more)


def rows(spark, ids, text="x"):
    return spark.createDataFrame([(f"k{i}", i, f"t{i}", text * (i % 5 + 1)) for i in ids], ROWS)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_not_shuffled_by_a_large_batch(spark, tmp_path, no_broadcast):
    t = table(spark, tmp_path)
    t.append(rows(spark, range(3000)), 0)
    hits = t.known(rows(spark, range(1000, 6000)))
    text = plan(hits)
    assert sorted(r.id for r in hits.collect()) == sorted(f"k{i}" for i in range(1000, 3000))
    # the batch is dealt to the buckets; the stored side has no exchange between scan and join
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text and "Broadcast" not in text
    stored_side = text[text.index("SortMergeJoin") :].split("Exchange hashpartitioning")[1]
    assert "Bucketed: true" in stored_side


def test_only_buckets_that_may_hit_are_opened(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, range(3000)), 0)
    key = rows(spark, [7])
    bucket = key.select(t.bucket(F.col("id"))).first()[0]
    text = plan(t.known(key))
    assert f"_({bucket:05d})" in text and t.known(key).count() == 1
    new = rows(spark, range(10_000, 12_000))
    assert t.possible(new).count() < 40  # false positives of the filters
    assert "FileScan" not in plan(t.known(rows(spark, [10**9]).where("false")))


def test_generations_stay_few_and_none_is_lost(spark, tmp_path):
    t = table(spark, tmp_path)
    for b in range(12):
        t.append(rows(spark, range(b * 40, b * 40 + 40)), b)
    assert len(t.generations()) <= 5
    assert sorted(r.arrival for r in t.read().collect()) == list(range(480))
    assert t.read(before=5).count() == 200 and t.known(rows(spark, range(470, 500))).count() == 10


def test_a_batch_that_fails_or_runs_again_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, range(100)), 0)
    bad = rows(spark, range(100, 120)).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        t.append(bad, 1)
    assert t.read().count() == 100 and len(t.generations()) == 1
    for _ in range(3):
        t.append(rows(spark, range(100, 120)), 1)
        t.vacuum()
    assert t.read().count() == 120 and t.read(before=1).count() == 100
    with pytest.raises(ValueError, match="8 buckets"):
        KeyedTable(spark, str(tmp_path), ROWS, "id", 4).read()


def merge(t):
    return lambda both: state.keep_longest(both, t.columns)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path, no_broadcast):
    t = table(spark, tmp_path)
    t.append(rows(spark, range(200)), 0)
    change = spark.createDataFrame([("k3", 900, "other", "a longer text")], ROWS)
    bucket = change.select(t.bucket(F.col("id"))).first()[0]
    for _ in range(2):  # the second time is a repeated batch
        t.upsert(change, 1, merge(t))
        old, new = t.generations()
        assert new.owned == [bucket] and old.owned == [b for b in range(8) if b != bucket]
        got = {r.id: (r.title, r.description) for r in t.read().collect()}
        assert len(got) == 200 and got["k3"] == ("t3", "a longer text") and got["k4"] == ("t4", "x" * 5)
    assert t.read(before=1).where("id = 'k3'").first().description == "x" * 4


def test_upserts_equal_successive_folds(spark, tmp_path):
    r = random.Random(2)
    t, want = table(spark, tmp_path), {}
    for b in range(6):
        batch = [(f"k{r.randrange(60)}", 100 * b + i, f"t{b}.{i}", r.choice([None, "", "aa", "bbbb", "c" * (b + 3)])) for i in range(30)]
        for id_, arrival, title, text in batch:
            if id_ not in want:
                want[id_] = (arrival, title, text)
            elif text is not None and (want[id_][2] is None or len(text) > len(want[id_][2])):
                want[id_] = (*want[id_][:2], text)
        df = spark.createDataFrame(batch, ROWS)
        t.upsert(state.first_and_longest(df), b, merge(t), most=3)
        t.vacuum()
    assert {r.id: tuple(r)[1:] for r in t.read().collect()} == want


def test_function_form_reads_the_state_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows(spark, range(50)).write.parquet(path)
    before = spark.read.parquet(path)
    batch = spark.createDataFrame([("k1", 60, "n", "y" * 9), ("k99", 61, "n", None), ("k99", 62, "m", "z")], ROWS)
    out = state.upsert_longest(before, batch)
    assert plan(out).count("FileScan parquet") == 1
    got = {r.id: (r.title, r.description, r.is_new) for r in out.collect()}
    assert len(got) == 51 and got["k1"] == ("t1", "y" * 9, False) and got["k99"] == ("n", "z", True) and got["k0"] == ("t0", "x", False)


def test_empty_tables_and_null_keys(spark, tmp_path):
    t = table(spark, tmp_path / "a")
    assert t.read().count() == 0 and t.known(rows(spark, [1])).count() == 0
    t.append(rows(spark, []), 0)
    assert t.read().count() == 0 and t.known(rows(spark, [1])).count() == 0
    t.append(spark.createDataFrame([(None, 1, "a", "b")], ROWS), 1)
    assert t.read().count() == 1 and t.known(spark.createDataFrame([(None, 1, "a", "b")], ROWS)).count() == 0
    folding = table(spark, tmp_path / "b", fold=lambda df: df.groupBy("id").agg(F.max("arrival").alias("arrival"), F.max("title").alias("title"), F.max("description").alias("description")))
    folding.append(rows(spark, range(90)), 0)
    folding.append(rows(spark, [1, 2]).withColumn("arrival", F.lit(500).cast("long")), 1)
    assert len(folding.generations()) == 2 and folding.read().count() == 90 and folding.read().where("arrival = 500").count() == 2
    assert folding.known(rows(spark, [1, 200])).count() == 1
