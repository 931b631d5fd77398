"""Every registered query against its SQL on another engine, and plan shapes."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in cur.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r["score"], r["doc_id"]))


@pytest.mark.parametrize("name", ["exclude_with_reason", "select_items", "items_cross_jobs", "prep_questions", "variant_scores", "claims_check"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = QUERIES["tokenize_terms"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_files(spark, tmp_path):
    from gleaner.operators.filters import unnotified_above
    from gleaner.sources.tables import read_postings, write_postings
    from gleaner.plans.views import Tables

    write_postings(Tables(spark, FOLDER).postings, str(tmp_path / "p"))
    plan = unnotified_above(read_postings(spark, str(tmp_path / "p")), 0.5).select("arrival")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(score,0.5)" in text
