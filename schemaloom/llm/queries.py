"""Registered queries of the operators: ``opN_<name>``(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, dartminhash, decontaminate, filteraudit, fsttokens, katz, langid,
               metrictree, sharding, tokenfiles, toxicity, warc)
from .common import fold, table


WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it is installed on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return (toxicity.score(docs, model)
            .select("doc_id", held.alias("held_out"), "score", "predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("learn"))
    return katz.score(docs).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens",
                                   "n_known", "train_tokens", "base_score", "score")


def op6_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (tokenfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (warc.archive(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "vslot"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    net = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    return (langid.predict(docs.select("doc_id", "text"), net)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrictree.compress(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsttokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                             table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_nearest, op3_toxicity, op4_decontaminate, op5_katz,
    op6_dartminhash, op7_token_files, op8_warc_revisits, op9_sharding, op10_language,
    op11_vector_codes, op12_token_counts, op13_filter_audit)}
