"""A training corpus from ``documents``: the stages below, one after the other."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, mixing, near_dedup, quality as quality_model, sentencepiece_bpe
from barloom.llm.common import table
from barloom.llm.queries import vocabulary
from barloom.sources.stage import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on rated documents; those go whose probability of the highest grade is below the bound chosen on held-out labels."""
    return quality_model.keep_good(docs, quality_model.fit(docs, quality_model.graded(table(spark, sf_dir, "labels"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity of 0.8; the smallest id of each group stays."""
    return near_dedup.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, in training order."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trips(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources to target weights", mixed), ("SentencePiece encoding and decoding", encoded)]
#: The classifier, the near duplicates and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
