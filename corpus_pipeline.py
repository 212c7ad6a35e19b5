"""The corpus pipeline: from raw documents to token ids of a clean, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents, with the same columns; the last returns ids.
The stages call the operators of `loadspark.llm` and add nothing of their own.

Defined results: a null or empty text is scored by the classifier's bias alone, has no copies and no secrets, and is not in a
mix of words; very long texts pass every stage whole; rows that repeat a key and text are one document for the
near-duplicates, different texts of one key are documents of their own; with equal similarity the smallest key stays. Empty
tables pass through all stages; columns behind those of `documents`, whatever their names, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.llm import mixing, near_dedup, quality_classifier, secret_scan, sentence_pieces
from loadspark.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier, trained on `labels`, does not reject."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_classifier.scorer(model)(F.col("text")) >= quality_classifier.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more on five-word shingles."""
    return near_dedup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    vocabulary = sentence_pieces.load_vocabulary()
    out = sentence_pieces.encode(docs, vocabulary, same="round_trip")
    return out.select("doc_id", "source", F.size("ids").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_copies),
    ("secret scan", mask_secrets),
    ("source mix", mix_sources),
    ("sentence pieces", encode),
]
#: Trained models and token ids are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
