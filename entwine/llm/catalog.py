"""The registered queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm import byte_bpe, chat_format, decontaminate, fingerprint, html_extract, jaccard_join, language, line_dedup, sql, token_files, url_filter
from entwine.llm.common import shared_dir, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at a Jaccard similarity of 0.85 or more."""
    return jaccard_join.classes_of(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows, and the items that occur."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.compare_with_edited(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.is_held_out() & F.col("doc_id").isNotNull()))
    return language.identify(docs.select("doc_id", language.is_held_out().alias("held_out"), "text"), model).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every document."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), RANKS)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


#: The conversation that the contract adds: control strings as text.
ADDED_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted output."""
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    chats = chat_format.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    read = chats.select("conv_id", "formatted", "valid", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("segments")).alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids with the end id, from files written and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, VOCABULARY, END_ID)
    return token_files.read_digests(spark, path)


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_jaccard_join, op2_decontaminate, op3_fingerprint, op4_line_dedup, op5_language, op6_byte_bpe, op7_html_extract, op8_url_filter, op9_chat_format, op10_token_files)}


def oracle_sql() -> dict:
    """Name -> DuckDB SQL with the same rows."""
    return dict(sql.ORACLES)
