"""From raw documents to encoded training data, in stages.

Low-quality documents go, then all but one of equal texts, then all but one of
each group of near copies; what is left is sampled to the target mixture, and the
sample is encoded. Each stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import exact_dedup, jaccard_join, mixing, quality_classifier, sentence_pieces
from lexiforge.llm.storage import settle, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    score, predicted = unused(docs, "_score"), unused(docs, "_predicted")
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 1).drop(score, predicted)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one of the least id."""
    return jaccard_join.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, with the target marginals."""
    return mixing.sample_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces."""
    return sentence_pieces.encode_and_decode(docs, sentence_pieces.default_model())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("encode", encode)]

#: The classifier and the encoder are no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
