"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; run() writes every stage's rows to the shared folder and
reads them again for the next, so a lost executor never costs more than one stage.

language_id      rejects documents of which no language can be told: no text, no letters, or a score under LEAST_SCORE, which
                 texts that are unlike all labelled texts of the language have (gibberish, languages that were not learned)
line_dedup       drops the lines of recurring templates, and documents of which no word is left
near_duplicates  keeps one document of each group: five-word shingles, Jaccard similarity of 0.8 or more
decontamination  drops documents in which a window of eight words of a benchmark item occurs
byte_bpe         encodes and decodes every text

A row is named by its doc_id and a hash of its text, so rows of one doc_id with different texts are judged apart; rows that are
equal in both are copies, of which one stays. A null doc_id counts as the largest. Null texts are rejected first, so later
stages only meet them in other use (they are in no group and have no passages); texts of any length are taken whole; ties between
rows of one doc_id go to the smaller hash; columns beside those of documents are handed on; an empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm import byte_bpe, decontaminate, jaccard_join, language, line_dedup
from entwine.llm.common import cut, table

LEAST_SCORE = 0.2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids that are sent to every task to be left out; more are left out by a join.
MOST_SENT = 2_000_000


def named(docs: DataFrame) -> DataFrame:
    """name (doc_id, null last, and the hash of the text) and text of every row."""
    return docs.select(name_of(), "text")


def name_of():
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("name")


def without(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs without the rows of the names (one column, name)."""
    gone = cut(names.select("name.*").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    name = name_of()
    same = (name["hash"] == gone["hash"]) & (name["none"] == gone["none"]) & name["id"].eqNullSafe(gone["id"])
    return docs.join(gone, same, "left_anti")


def single(docs: DataFrame) -> DataFrame:
    """docs with one row of each name; only rows of repeated names are compared."""
    twice = cut(docs.where("text is not null").groupBy(name_of()).count().where("count > 1").select("name"), "repeated")
    if twice.isEmpty():
        return docs
    again = docs.withColumn("_name", name_of()).join(twice.withColumnRenamed("name", "_twice"), F.col("_name") == F.col("_twice"), "left_semi").dropDuplicates(["_name"]).drop("_name")
    return without(docs, twice).unionByName(again)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    told = language.identify(docs, language.fit(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text."""
    kept = line_dedup.dedup(docs).where(F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    classes = jaccard_join.classes_of(named(docs), key="name", n=5, share=Fraction(8, 10))
    return single(without(docs, classes.where("name <> component_id").select("name")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = decontaminate.contamination(named(docs), table(spark, sf_dir, "benchmark"), key="name")
    return without(docs, found.where("n_hit > 0").select("name"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the decoded bytes."""
    made = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("byte_bpe", encode)]

#: SQL cannot express hashes of words and the fitted model; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
