"""Reference and master tables read from comma-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ORD, unique_headers


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text table with upper-case titles and its file order in ``_ord``."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    order = F.struct(
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = df.select("*", order.alias(ORD))
    return ordered.toDF(*unique_headers(df.columns), ORD)
