"""One registered query per operator, over its whole table, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import chat, codes, langid, mixing, packing, quality, simhash, spelling, sqltext, substrings, suffix, topk, urls, wrapper
from gleaner.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op9_simhash_groups")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hex_digits(groups["fp"]).alias("fingerprint"), "component_id")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix.without_repeats(table(spark, folder, "documents"), each_text=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_pack_sequences")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), packing.public_tokenizer())


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = langid.fold(F.col("doc_id")) == 2
    model = langid.fit(docs.where(~held_out))
    rows = langid.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op1_mix_sources", sqltext.OP1)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_url_filter", sqltext.OP2)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark))


@query(
    "op7_quality_rules",
    sqltext.op7(quality.SENTENCE_WORDS, quality.END_MARKS, quality.NAVIGATION, quality.BOILERPLATE, quality.MAX_LOST_PERCENT),
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.clean(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_chat_format", sqltext.OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.with_marked_conversation(spark, table(spark, folder, "conversations"))
    return chat.read_back(chat.segments(turns))


@query("op5_exact_top_k", sqltext.OP5)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_html_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = wrapper.main_text(table(spark, folder, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@query("op11_substring_dedup", sqltext.OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.without_passages(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_vector_codes", sqltext.OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = codes.encode(table(spark, folder, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


@query("op13_spelling_variants", sqltext.OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))
