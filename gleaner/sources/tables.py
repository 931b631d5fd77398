"""Typed scans of stored tables, text files and master items; writers for the outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.documents import ITEM_TYPE

# (name, type) of the stored postings
POSTING_SCHEMA = [
    ("id", "string"), ("arrival", "bigint"), ("source", "string"), ("title", "string"),
    ("company", "string"), ("location", "string"), ("url", "string"), ("description", "string"),
    ("posted_at", "string"), ("first_seen", "timestamp"), ("score", "double"),
    ("notified", "boolean"), ("salary_min", "bigint"), ("salary_max", "bigint"),
    ("job_type", "string"), ("skills", "array<string>"), ("job_hash", "string"),
    ("deadline", "date"), ("application_status", "string"), ("applied_at", "timestamp"),
    ("application_notes", "string"), ("suitability_score", "double"),
    ("suitability_reason", "string"), ("qualification_verdict", "string"),
    ("unmet_requirements", "array<string>"),
]
TEXT_COLUMNS = ("title", "company", "location", "description", "job_type")


def conform(df: DataFrame, schema: list[tuple[str, str]] = POSTING_SCHEMA) -> DataFrame:
    """The posting schema over any older table: late columns null, texts never null."""
    columns = []
    for name, kind in schema:
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in TEXT_COLUMNS:
            c = F.coalesce(c, F.lit(""))
        elif name == "notified":
            c = F.coalesce(c, F.lit(False))
        elif kind == "array<string>":
            c = F.coalesce(c, F.array().cast(kind))
        columns.append(c.alias(name))
    return df.select(*columns)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.option("mergeSchema", "true").parquet(path))


def write_postings(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("source").parquet(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


MASTER_SCHEMA = (
    "contact struct<name:string,location:string,phone:string,email:string>,"
    "summaries map<string,string>,"
    "items array<struct<id:string,section:string,"
    "content:struct<title:string,sub:string,bullets:array<string>>,tags:array<string>,core:boolean>>"
)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MASTER_SCHEMA).json(path, multiLine=True)


def master_items(master: DataFrame) -> DataFrame:
    """One flat row per item, in file order."""
    i = F.col("_i")
    return master.select(F.posexplode("items").alias("_p", "_i")).select(
        (F.col("_p") + 1).alias("pos"),
        i["id"].alias("id"),
        i["section"].alias("section"),
        i["content"]["title"].alias("title"),
        F.coalesce(i["content"]["sub"], F.lit("")).alias("sub"),
        F.coalesce(i["content"]["bullets"], F.array().cast("array<string>")).alias("bullets"),
        F.transform(i["tags"], lambda t: F.trim(t)).alias("tags"),
        F.coalesce(i["core"], F.lit(False)).alias("core"),
    )


AUDIT_SCHEMA = (
    "timestamp string, job_id string, title string, company string, method string, match_score double,"
    " suitability_score double, letter_path string, action string, recipient string, validation_warnings array<string>, error string"
)


def append_audit_log(df: DataFrame, path: str, *carried: str) -> None:
    """JSON lines; the recipient is kept for e-mail only. ``carried`` columns are logged as well."""
    audit_rows(df, *carried).write.mode("append").json(path)


def read_audit_log(spark: SparkSession, path: str, carried: str = "") -> DataFrame:
    return spark.read.schema(", ".join(x for x in (carried, AUDIT_SCHEMA) if x)).json(path)


def audit_rows(df: DataFrame, *carried: str) -> DataFrame:
    return df.select(
        *carried, "timestamp", "job_id", "title", "company", "method", "match_score", "suitability_score",
        "letter_path", "action",
        F.when(F.col("method") == "email", F.col("target")).alias("recipient"),
        "validation_warnings",
        "error",
    )


def write_texts(df: DataFrame, path: str, text: str, by: str) -> None:
    """Documents as JSON lines under one folder per ``by`` value."""
    df.select(by, text).write.mode("overwrite").partitionBy(by).json(path)


__all__ = [
    "ITEM_TYPE", "MASTER_SCHEMA", "POSTING_SCHEMA", "append_audit_log", "audit_rows", "conform",
    "read_audit_log",
    "master_items", "read_master", "read_postings", "read_text_files", "write_postings",
    "write_texts",
]
