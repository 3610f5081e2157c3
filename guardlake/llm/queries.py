"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm import (
    centroids,
    common,
    embeddings,
    licenses,
    linededup,
    negatives,
    packing,
    pieces,
    ppm,
    quality,
    simhash,
    toxicity,
    warc,
    winnowing,
)
from guardlake.llm.oracle import ORACLE as ORACLE


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.responses(common.load(spark, sf_dir, "pages")).select("page_id", "record")
    found = warc.derive(common.spread(pages))
    kept = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "block", "block_digest"]
    return found.select(*kept, F.sha2("derived", 256).alias("record_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.spread(common.load(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edits(common.load(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.load(spark, sf_dir, "labels"))
    scored = toxicity.score(common.spread(docs.select("doc_id", "text")), model)
    return scored.select(
        "doc_id",
        common.held_out(F.col("doc_id"), 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(common.load(spark, sf_dir, "embeddings"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(common.load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicate(docs).select("doc_id", F.length("text").alias("n_chars"), "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.tokenized(common.load(spark, sf_dir, "documents"), path, end_id=2, capacity=1024)
    return packing.pack(pieces, capacity=1024)


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(common.load(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = common.written(quality.measured(docs).select("doc_id", "statistics"), "statistics")
    scored = quality.score(rows, quality.train(rows, common.load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        common.held_out(F.col("doc_id"), 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = common.load(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(centroids.cluster(common.load(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_winnowing": op4_winnowing,
    "op5_toxicity": op5_toxicity,
    "op6_embeddings": op6_embeddings,
    "op7_pieces": op7_pieces,
    "op8_linededup": op8_linededup,
    "op9_packing": op9_packing,
    "op10_ppm": op10_ppm,
    "op11_quality": op11_quality,
    "op12_negatives": op12_negatives,
    "op13_centroids": op13_centroids,
}

