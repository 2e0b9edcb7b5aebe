"""Small frames from driver-side values, as local relations the optimizer can size."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A frame of a few rows. Going through Arrow makes it a LocalRelation, not an RDD."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.names
    data = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema)
    )
    return spark.createDataFrame(data, schema)
