"""First-hit lookups that survive large reference tables and hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ReportValidationError
from ..functions import ORD, as_text, col, strip
from .columns import (
    LOOKUP_KEY,
    MAIN_BRANCH,
    MAIN_CODE,
    header_form,
    key_aliases,
    rename_alias,
    rename_reference,
)
from .joins import JoinPolicy, left_lookup

UNMAPPED = "UNMAPPED"


def row_order(df: DataFrame, order_by: str | None) -> Column:
    """The column that says which row comes first. There is no default order."""
    name = order_by or ORD
    if name not in df.columns:
        raise ReportValidationError(
            f"first-hit rules need a row order: pass order_by or a {ORD!r} column"
        )
    return col(name)


def first_hit(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order_by: str | None = None
) -> DataFrame:
    """One row per key: the values of its first row in row order.

    A partial aggregate runs before the shuffle, so a key that holds a large share of
    all rows arrives as one row per task. Fixed-width values aggregate by hash.
    """
    order = row_order(df, order_by)
    if len(values) == 1 and isinstance(df.schema[values[0]].dataType, T.NumericType):
        best = df.groupBy(*map(col, keys)).agg(F.min_by(col(values[0]), order).alias(values[0]))
        return best
    best = df.groupBy(*map(col, keys)).agg(
        F.min_by(F.struct(*map(col, values)), order).alias("_first")
    )
    return best.select(*map(col, keys), *[F.col("_first")[v].alias(v) for v in values])


def keep_raw_names(df: DataFrame, names: Sequence[str] = (MAIN_CODE, MAIN_BRANCH)) -> DataFrame:
    """Raw columns that share a looked-up name move aside as ``RAW_<name>``."""
    return df.withColumnsRenamed({n: f"RAW_{n}" for n in names if n in df.columns})


def reference_lookup_table(
    reference: DataFrame, key: str = LOOKUP_KEY, order_by: str | None = None
) -> DataFrame:
    """Key, code and branch, one row per trimmed key: the first in row order."""
    key = header_form(key)
    named = rename_reference(reference, key)
    order = row_order(named, order_by)
    text = named.select(
        strip(as_text(named, key)).alias(key),
        as_text(named, MAIN_CODE).alias(MAIN_CODE),
        as_text(named, MAIN_BRANCH).alias(MAIN_BRANCH),
        order.alias(ORD),
    ).where(col(key).isNotNull())
    return first_hit(text, [key], [MAIN_CODE, MAIN_BRANCH])


def attach_branch(
    raw: DataFrame,
    reference: DataFrame,
    key: str = LOOKUP_KEY,
    order_by: str | None = None,
    policy: JoinPolicy = JoinPolicy(),
) -> DataFrame:
    """Each raw row with its branch code and name; a row without a hit has nulls.

    Keys compare as trimmed text and nothing more: ``1`` is not ``0001``.
    """
    key = header_form(key)
    raw = rename_alias(keep_raw_names(raw), key_aliases(key), key)
    if key not in raw.columns:
        raise ReportValidationError(
            f"lookup key {key!r} is absent from the input. Available columns: "
            f"{[c for c in raw.columns if not c.startswith('_')]}"
        )
    keyed = raw.withColumn(key, F.coalesce(strip(as_text(raw, key)), F.lit("")))
    return left_lookup(keyed, reference_lookup_table(reference, key, order_by), key, policy)


def fill_unmapped(df: DataFrame, columns: Sequence[str] = (MAIN_CODE, MAIN_BRANCH)) -> DataFrame:
    """Missing codes and names become ``UNMAPPED``, each on its own."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(UNMAPPED)) for c in columns})


def lookup_branch(raw, reference, key=LOOKUP_KEY, order_by=None, policy=JoinPolicy()) -> DataFrame:
    """The spreadsheet lookup: branch code and name, ``UNMAPPED`` where there is none."""
    return fill_unmapped(attach_branch(raw, reference, key, order_by, policy))


def unmapped_counts(attached: DataFrame, code: str = MAIN_CODE) -> DataFrame:
    """One row: rows matched and unmapped. A hit with a missing code counts as unmapped."""
    return attached.agg(
        F.count(col(code)).alias("matched_rows"),
        F.count_if(col(code).isNull()).alias("unmapped_rows"),
    )


def unmapped_keys(attached: DataFrame, key: str = LOOKUP_KEY, code: str = MAIN_CODE) -> DataFrame:
    """The distinct keys without a code, ascending."""
    return attached.where(col(code).isNull()).select(col(key)).distinct().orderBy(col(key))
