"""A corpus pipeline of five stages, each written as a table and read again as the documents of the next.

Toxic documents go, then exact copies, then near copies (one document of each group stays); the rest is mixed to the
target weights of its sources, and the mixed texts are encoded and decoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from barloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.op8_rows(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("n-gram join", drop_near_copies), ("mix sources", mix_sources), ("byte BPE", encode)]

#: Training and BPE have no SQL form; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
