"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. Defined cases are those of the
operators; rows without doc_id pass the near-duplicate stage and are cut, each as a document of its
own, by the passage stage; texts that lost all their bytes stay as empty documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid, mixing, packing, simhash, suffix
from gleaner.llm.base import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier does not reject."""
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 2))
    return langid.identify(docs, model).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or the same one, has already."""
    cut = suffix.cut_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs, mixing.mix(docs)).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences."""
    return packing.pack_documents(docs, packing.public_tokenizer())


STAGES = [
    ("language identification", known_language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]

# Fingerprints, hashed n-grams, byte spans and tokens have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
