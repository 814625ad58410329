"""The corpus pipeline: its stages, the run over ``documents``, and its check SQL.

Quality classifier, toxicity, near-duplicates, mixing to target weights, SentencePiece tokens. Each stage
is given what the one before has kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import cotraining, minhash, mixing, piece_tokens, toxicity
from plumbline.llm.common import crc_fold, stored, table
from plumbline.llm.queries import MODEL_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotraining.good_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; a fifth of the labels is kept out of the learning."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 5) != 0).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and more."""
    return minhash.deduplicated(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row per copy taken, so an id may come up to three times."""
    return mixing.mixed_documents(docs, COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix."""
    encoded = piece_tokens.encode(docs, MODEL_FILE, keep=("lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("toxicity", nontoxic), ("near_duplicates", distinct), ("mixing", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
