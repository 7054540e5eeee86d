"""Corpus pipeline: toxicity, language ID, near-duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps
with their columns; the last returns their tokens. Stages work on all that
their predecessor kept. Models and the benchmark come from the tables of
``sf_dir``; nothing is limited or sampled but the documented training samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import bpe, dartminhash, decontaminate, langid, toxicity
from schemaloom.llm.common import fold, saved, table
from schemaloom.llm.queries import WORD_BPE, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with predicted = 1 (score of 0.5 or more)."""
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(table(spark, sf_dir, "documents"),
                         table(spark, sf_dir, "labels").where(~held))
    marked = toxicity.score(docs, model, ("_toxicity", "_toxic", "_evidence"))
    return marked.where(F.col("_toxic") == 0).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is 'und': null, or without a letter. The
    network's language and probability reject nothing, so texts with a letter stay
    even if there is no row to learn a language from."""
    held = fold(F.col("doc_id"), 3) == 1
    net = langid.train(table(spark, sf_dir, "documents").where(~held)
                       .select("doc_id", "text", "lang"))
    if net is None:
        return langid.with_letter(docs)
    marked = langid.predict(docs, net, ("_language", "_probability"))
    return marked.where(F.col("_language") != langid.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every class of near-duplicate texts, that of the smallest
    id; rows without id are compared too, and other texts of an id stay."""
    return dartminhash.one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which benchmark windows hit 1 word in 20 or more."""
    # decided and applied by row: ids may be null or repeated
    rows = saved(docs.withColumn("_row_key", F.monotonically_increasing_id()), "pipeline_rows")
    found = decontaminate.contamination(rows.select(F.col("_row_key").alias("doc_id"), "text"),
                                        table(spark, sf_dir, "benchmark"))
    bad = saved(found.where("contaminated").select(F.col("doc_id").alias("_row_key")),
                "contaminated")
    return rows.join(bad, "_row_key", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to."""
    return bpe.encode(docs, vocabulary(WORD_BPE)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages),
          ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("bpe", tokenize)]

ORACLE_SQL = None  # trained models and BPE: tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
