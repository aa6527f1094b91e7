"""A corpus pipeline: each stage takes all that the one before it kept.

Null and empty texts have no letter, so language ID rejects them. Extra columns of documents pass through every stage but the
last. The mix may repeat a document; its copies are rows with the same doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.exact_dedup import drop_exact_copies
from strandline.llm.langid import keep_identified
from strandline.llm.mixing import mix
from strandline.llm.near_texts import drop_similar
from strandline.llm.queries import MODEL
from strandline.llm.sentencepiece import Pieces, round_trip


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter, or like no language, go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that links of similarity 0.8 on five-word shingles join."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text, for each row of the mix."""
    pieces = Pieces.load(MODEL)
    return round_trip(docs, pieces).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "same_text")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing sources", mixing),
    ("encode and decode", tokens),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
