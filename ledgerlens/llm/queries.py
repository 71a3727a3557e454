"""The operators over the input tables: one query per operator, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .common import crc_fold
from .exact import exact_groups
from .lm import language_model_scores
from .lines import line_dedup
from .merkle import manifest, proof_digest
from .mixing import mix_documents
from .near import near_groups
from .pages import extract_pages
from .pieces import encode_digests as piece_digests
from .spots import edit_report
from .token_counts import count_tokens
from .toxicity import Model, fit, score_documents
from .turns import repair_report


def _table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its source as host: lines, dropped lines and the digest of the text that stays."""
    df = line_dedup(_table(spark, folder, "documents").select("doc_id", "source", "text"), "source", "text")
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op2_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by the model of the documents whose crc32 modulo 10 is not 0."""
    df = language_model_scores(_table(spark, folder, "documents"), crc_fold(F.col("doc_id"), 10) != 0)
    return df.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(_table(spark, folder, "pages"))


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    df = mix_documents(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return df.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"), keep="max")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_digests(_table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_table(spark, folder, "documents"), width=2, percent=80).drop("key")


def toxicity_model(spark: SparkSession, folder: str) -> Model:
    """Fitted on the labelled documents whose crc32 modulo 5 is not 0."""
    labels = _table(spark, folder, "labels").where(crc_fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    return fit(_table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    df = score_documents(_table(spark, folder, "documents"), toxicity_model(spark, folder))
    held = crc_fold(F.col("doc_id"), 5) == 0
    return df.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document with its share of the document's tokens."""
    return count_tokens(_table(spark, folder, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_report(_table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation after the stated damage: its faults, the cheapest repair and the digest of what it gives."""
    return repair_report(_table(spark, folder, "conversations"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a leaf; where 7 divides the id's crc32, a version adds one to n_chars."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    df = manifest(_table(spark, folder, "documents"), hit)
    return df.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", "verified")


def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(_table(spark, folder, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_html_extraction": op3_html_extraction,
    "op4_source_mixing": op4_source_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle": op12_merkle,
    "op13_sentencepiece": op13_sentencepiece,
}
