"""Keep-lists and drop-lists on a text dimension."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_text, col, fold, strip
from ..sources.local import local_frame
from .columns import KW_ALIASES, resolve_alias

FilterValues = str | Iterable[str] | None

# A dimension stored once in folded form can be filtered by the parquet reader itself.
FOLDED_SUFFIX = "__FOLDED"


def filter_values(values: FilterValues) -> list[str]:
    """Trimmed values without blanks, in order; nothing at all means no filter."""
    if values is None:
        return []
    listed = [values] if isinstance(values, str) else list(values)
    return list(dict.fromkeys(v for v in (str(x).strip() for x in listed) if v))


def _folded(values: Sequence[str]) -> list[Column]:
    # Folded by Spark, so both sides follow the same case rules; constant-folded in plan.
    return [F.lower(F.lit(v)) for v in values]


def dimension_condition(
    df: DataFrame, column: str, include: FilterValues = None, exclude: FilterValues = None
) -> Column | None:
    """The row condition of a keep-list and a drop-list on one column.

    Blank cells are on no list: a drop-list leaves them, a keep-list does not.
    """
    keep, drop = filter_values(include), filter_values(exclude)
    if not keep and not drop:
        return None
    stored = column + FOLDED_SUFFIX
    value = col(stored) if stored in df.columns else fold(as_text(df, column))
    condition = None
    if keep:
        condition = value.isin(*_folded(keep))
    if drop:
        not_dropped = ~value.isin(*_folded(drop))
        condition = not_dropped if condition is None else condition & not_dropped
    return condition


def filter_dimension(
    df: DataFrame,
    aliases: Sequence[str],
    include: FilterValues = None,
    exclude: FilterValues = None,
) -> DataFrame:
    """Filter on the first alias present; without any of them the frame is unchanged."""
    column = resolve_alias(df.columns, aliases)
    if column is None:
        return df
    condition = dimension_condition(df, column, include, exclude)
    return df if condition is None else df.where(condition)


def filter_segment(df, include: FilterValues = None, exclude: FilterValues = None) -> DataFrame:
    return filter_dimension(df, ["SEGMEN"], include, exclude)


def filter_source(df, include: FilterValues = None, exclude: FilterValues = None) -> DataFrame:
    return filter_dimension(df, ["SOURCE"], include, exclude)


def filter_kw(df, include: FilterValues = None) -> DataFrame:
    return filter_dimension(df, KW_ALIASES, include)


def fold_dimensions(df: DataFrame, names: Sequence[str] = ("SEGMEN", "SOURCE", *KW_ALIASES)) -> DataFrame:
    """Add the folded form of each filter dimension, for a frame about to be stored.

    Later keep- and drop-lists on the stored table become plain ``IN`` predicates, which
    reach the parquet scan.
    """
    present = [n for n in names if n in df.columns]
    return df.withColumns({n + FOLDED_SUFFIX: fold(as_text(df, n)) for n in present})


def dimension_values(df: DataFrame, aliases: Sequence[str]) -> DataFrame:
    """The values a dimension holds (upper case) and how many rows carry each."""
    column = resolve_alias(df.columns, aliases)
    if column is None:
        return local_frame(df.sparkSession, [], "value string, rows long")
    value = F.coalesce(F.upper(strip(as_text(df, column))), F.lit(""))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
