"""The corpus pipeline: from raw documents to the token ids of a mixed, deduplicated corpus.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and works on
all that its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``.

Cases: a stage reads the five columns of ``documents`` and drops any other, so that no
name can clash; missing values, empty and very long texts, ties and repeated rows go
through each stage as its operator states; of a document that stands several times
with one id and text, near-dedup keeps one row; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import encode_documents
from ledgerlens.llm.common import crc_fold
from ledgerlens.llm.lines import line_dedup
from ledgerlens.llm.mixing import repeat_documents
from ledgerlens.llm.near import keep_one
from ledgerlens.llm.toxicity import fit, keep_ordinary
from ledgerlens.session import discard, scratch, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The labels with crc32(doc_id) modulo 5 = 0 stay unseen."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    labels = labels.where(crc_fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    return keep_ordinary(docs.select(COLUMNS), fit(docs.select("doc_id", "text").join(labels, "doc_id")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave the texts."""
    df = line_dedup(docs.select(COLUMNS), "source", "text")
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 on five-word shingles stays."""
    return keep_one(docs.select(COLUMNS), width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return repeat_documents(docs.select(COLUMNS))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row: ``doc_id, n_tokens, ids``."""
    # Workers that ran the stages before still hold their memory, so words get little of it here.
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    df = encode_documents(docs.select("doc_id", "text"), path, words=60_000)
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("BPE", bpe),
]

# The first stage compresses texts with trained dictionaries, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and goes when the next has read it."""
    docs, before = tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for label, stage in STAGES[:-1]:
        path = scratch(spark, label.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
