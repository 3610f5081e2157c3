"""Stages of the corpus pipeline: (spark, docs, sf_dir) in, a frame of documents out, but for the last one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm import common, linededup, packing, simhash, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.5 or more; the model learns from the labels of the given documents."""
    score = common.fresh(docs, "score")
    model = toxicity.train(docs, common.load(spark, sf_dir, "labels"))
    return toxicity.score(common.spread(docs), model, column=score).where(F.col(score) < 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines; ``n_chars`` follows. A document of repeated lines only stays, with no text."""
    return linededup.deduplicate(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.tokenized(docs, path, end_id=2, capacity=1024), capacity=1024)
