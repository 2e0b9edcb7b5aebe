"""A pipeline over ``documents``: each stage applies one operator to what the stage before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` stores each stage's
rows as Parquet in the shared checkpoint folder and reads them back for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchtally.llm import bpe, mixing, ngram_join, secrets, toxicity
from branchtally.llm.common import table
from branchtally.session import ensure_checkpoint_dir

#: SQL cannot state the trained classifier or the tokenizer; ``tests/llm`` checks by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their language's threshold does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links; the one with the smallest id."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets replaced."""
    scanned = secrets.scan(docs, secrets.train(docs))
    redacted = scanned.withColumn("text", secrets.redact(scanned))
    length = F.when(F.size(F.concat(*secrets.KINDS)) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
