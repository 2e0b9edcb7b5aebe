"""Why a lookup missed almost everything. Advisory: a run never fails because of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col
from .lookup import UNMAPPED, row_order

MISS_THRESHOLD = 0.99
SAMPLE_SIZE = 5


def key_sample(df: DataFrame, key: str, order_by: str | None = None, n: int = SAMPLE_SIZE) -> DataFrame:
    """The first ``n`` keys in row order, as ``position, key``.

    A top-n per task, merged: nothing is sorted as a whole.
    """
    order = row_order(df, order_by)
    top = df.select(col(key).cast("string").alias("key"), order.alias("_o")).orderBy("_o").limit(n)
    listed = top.agg(F.array_sort(F.collect_list(F.struct("_o", "key"))).alias("a"))
    return listed.select(F.posexplode("a").alias("position", "e")).select(
        "position", F.col("e.key").alias("key")
    )


def mostly_unmapped(unmapped: Column, total: Column, threshold: float = MISS_THRESHOLD) -> Column:
    return (total > 0) & (unmapped / F.greatest(total, F.lit(1)) >= F.lit(threshold))


def miss_report(
    attached: DataFrame, code: str, threshold: float = MISS_THRESHOLD
) -> DataFrame:
    """One row: ``total_rows, unmapped_rows, unmapped_share, warn``."""
    counts = attached.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(col(code).isNull()).alias("unmapped_rows"),
    )
    share = F.when(F.col("total_rows") > 0, F.col("unmapped_rows") / F.col("total_rows"))
    return counts.select(
        "total_rows",
        "unmapped_rows",
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("unmapped_share"),
        mostly_unmapped(F.col("unmapped_rows"), F.col("total_rows"), threshold).alias("warn"),
    )


def miss_message(
    context: str,
    unmapped: int,
    total: int,
    raw_keys: Sequence[str],
    reference_keys: Sequence[str],
    aliases: Sequence[str],
) -> str | None:
    """The advisory text, or None when the miss rate is ordinary."""
    if total <= 0 or unmapped / total < MISS_THRESHOLD:
        return None
    return (
        f"{context}: {unmapped / total:.1%} of rows ({unmapped}/{total}) are {UNMAPPED}; "
        "the keys on the two sides probably do not match.\n"
        f"  keys in the input: {list(raw_keys)}\n"
        f"  keys in the reference: {list(reference_keys)}\n"
        f"  headers tried: {list(aliases)}"
    )
