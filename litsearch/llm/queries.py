"""Registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.llm.common import fold_of, load
from litsearch.llm.conversation_repair import conversation_sql
from litsearch.llm.embedding_join import ORACLE_SQL as EMBEDDING_SQL
from litsearch.llm.merkle import manifest_sql


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.exact_dedup import exact_dedup
    return exact_dedup(load(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.language_id import fit, identify
    docs = load(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.piece_codec import encode
    return encode(load(spark, sf_dir, "documents"), digest=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.mixing import taken
    return taken(load(spark, sf_dir, "documents"))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.fertility import fertility_rules
    return fertility_rules(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.line_dedup import line_report
    return line_report(load(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.quality_gam import fit, score
    docs = load(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = fit(docs, load(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.secret_scan import digest, scan, train
    docs = load(spark, sf_dir, "documents")
    return digest(scan(docs, train(docs))).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.toxicity import fit, score
    docs = load(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    net = fit(docs, load(spark, sf_dir, "labels"), ~held_out)
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.ngram_join import similar_groups
    return similar_groups(load(spark, sf_dir, "documents"), words=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.merkle import manifest
    return manifest(load(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.conversation_repair import damaged, repair
    return repair(damaged(load(spark, sf_dir, "conversations"))).drop("widest")


def op13_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litsearch.llm.embedding_join import near_groups
    return near_groups(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_mixing": op4_mixing,
    "op5_fertility": op5_fertility,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_join": op13_embedding_join,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_merkle_manifest": manifest_sql(),
    "op12_conversation_repair": conversation_sql(),
    "op13_embedding_join": EMBEDDING_SQL,
}
