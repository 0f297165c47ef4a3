"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Given results: a null text is as an empty one; empty texts are near copies of each other, so that one stays, are never toxic nor
contaminated, have no words to mix and 8 bytes in their shard. Repeated rows stand for documents each, until the near-duplicate
stage keeps one. A null id takes part like any other; a null source is a source. Of documents that are equal in what decides,
hashes decide. An empty table gives an empty one. Columns of any name stay as they are, but for the last stage, which returns places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import cube_mixing, near_copies, ring_sharding, simhash, toxicity, winnowing
from readloom.llm.common import delete_path, discard, materialise, numbered, parent_of, place_of, tables_now

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on those with labels, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(numbered(docs), model, place_of(docs, "text"), "toxicity")
    return scored.where(F.col("toxicity") < 0.5).drop("toxicity").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8."""
    return simhash.keep_one(docs, find=near_copies.components)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    return winnowing.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return cube_mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot."""
    return ring_sharding.digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", near_duplicates),
    ("winnowing", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express a trained classifier, components of near copies, or the cube method.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written before the next one reads it; the tables that a stage made meanwhile are deleted, and then its input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        there = tables_now(spark)
        docs = materialise(stage(spark, docs, sf_dir), name)
        for path in tables_now(spark) - there:
            if path != parent_of(docs):
                delete_path(spark, path)
        if before is not None:
            discard(before)
        before = docs
    return docs
