"""What the operators of this subpackage share: tables, cut lineage, per-column selection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.keyed import global_rank
from gleaner.session import ensure_checkpoint_dir

# The white space of the word rule [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    Cuts the lineage like ``checkpoint()``. As the size of the files is known to the planner, Spark
    itself decides by its threshold whether a later join may broadcast the table. The files lie
    under the name of the application, so they can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches by bytes, so that long texts don't pile up in a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def numbered(rows: DataFrame, doc_id: str, text: str, number: str, no_id: int) -> DataFrame:
    """``rows`` with a number per document, in the order of doc_id, nulls first, then text.

    Rows with one id and one text are one document; a row without id is a document of its own. Where
    no id repeats, the id is the number and nothing is moved; else the rows are sorted once.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(no_id))
    if not stored(rows.groupBy(key.alias("key")).count().where("count > 1").select("key")).take(1):
        return rows.withColumn(number, key)
    value = F.coalesce(F.col(text), F.lit(""))
    row, id_, digest, first = free_names(rows.withColumn(number, key), "row_", "id_", "digest", "first_")
    marked = rows.withColumn(row, F.monotonically_increasing_id())
    ranked = global_rank(marked, [F.col(doc_id).asc_nulls_first(), value, F.col(row)], number).drop(row)
    ranked = ranked.withColumn(digest, F.sha2(value, 256))
    same = ranked.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(id_), F.col(digest).alias(f"{digest}_of"))
    same = same.agg(F.min(number).alias(first), F.count("*").alias("n")).where("n > 1").drop("n")
    out = ranked.join(same, (F.col(doc_id) == F.col(id_)) & (F.col(digest) == F.col(f"{digest}_of")), "left")
    return out.withColumn(number, F.coalesce(first, number)).select(*rows.columns, number)


def n_words(text: Column) -> Column:
    """Words of a text as the word rule counts them; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shards(rows: int, per_shard: int, least: int = 1) -> int:
    """How many shards hold ``rows`` with about ``per_shard`` in each."""
    return max(least, -(-rows // per_shard))
