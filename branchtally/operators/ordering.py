"""The fixed row order of report summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_text, canonical_branch_code, col, text_list

# Branch codes in the order the receiving dashboard lists them.
BRANCH_ORDER = (
    "7", "9", "13", "577", "21", "33", "516", "44", "45", "49", "51", "344", "579",
    "429", "56", "57", "67", "555", "65", "70", "73", "90", "177", "110", "551",
)
UNLISTED = len(BRANCH_ORDER)


def branch_position(code: Column) -> Column:
    """0-based place of a branch code in the dashboard; unlisted codes share the last."""
    listed = F.array_position(F.expr(f"array({text_list(BRANCH_ORDER)})"), canonical_branch_code(code))
    return F.when(listed > 0, (listed - 1).cast("int")).otherwise(F.lit(UNLISTED))


def with_position(df: DataFrame, code: str, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.coalesce(branch_position(as_text(df, code)), F.lit(UNLISTED)))


def sort_for_dashboard(df: DataFrame, code: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rows in dashboard order; unlisted codes follow, ascending by the tie columns."""
    if code not in df.columns:
        return df
    position = F.coalesce(branch_position(as_text(df, code)), F.lit(UNLISTED))
    return df.orderBy(position, *[col(c) for c in ties if c in df.columns])
