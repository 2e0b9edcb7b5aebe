"""Branch sums and counts, grand totals, whole-unit rounding, headline figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReportValidationError
from ..functions import (
    as_text,
    col,
    merge_totals,
    money_total,
    parse_balance,
    settle,
    strip,
    whole_units,
)
from ..functions.text import strip_control_chars
from .columns import MAIN_BRANCH, MAIN_CODE
from .ordering import UNLISTED, branch_position

GROUP_COLUMNS = (MAIN_CODE, MAIN_BRANCH)
TOTAL_LABEL = "Grand Total"


def non_blank(df: DataFrame, name: str) -> Column:
    """Counts a cell that is neither missing nor white space."""
    return F.coalesce(strip(as_text(df, name)) != "", F.lit(False))


def number_or_zero(df: DataFrame, name: str) -> Column:
    """A value column as double. Text that is no plain number is 0, also with commas."""
    return F.coalesce(parse_balance(col(name), df.schema[name].dataType), F.lit(0.0))


def summarize(
    df: DataFrame,
    group_columns: Sequence[str] = GROUP_COLUMNS,
    value_columns: Sequence[str] = ("VOLUME_IN_IDR",),
    how: str = "sum",
) -> DataFrame:
    """The pivot: one row per group, each value column summed or counted.

    Sums are exact and then rounded half-even to two decimals; counts are of non-blank
    cells. Missing group values form a group of their own.
    """
    sums = partial_sums(df, group_columns, value_columns, how)
    return _settled(sums, group_columns, value_columns, how)


def partial_sums(
    df: DataFrame, keys: Sequence[str], value_columns: Sequence[str], how: str = "sum"
) -> DataFrame:
    """Per key: the unrounded total or the count of each value column, and ``_rows``."""
    if how not in ("sum", "count"):
        raise ValueError(f"unknown aggregate {how!r}; use 'sum' or 'count'")
    missing = [c for c in value_columns if c not in df.columns]
    if missing:
        raise ReportValidationError(f"value column(s) {missing} are absent from the input")
    if how == "count":
        cells = [non_blank(df, c).alias(c) for c in value_columns]
        values = [F.count_if(col(c)).alias(c) for c in value_columns]
    else:
        cells = [number_or_zero(df, c).alias(c) for c in value_columns]
        values = [money_total(c).alias(c) for c in value_columns]
    rows = df.select(*map(col, keys), *cells)
    return rows.groupBy(*map(col, keys)).agg(*values, F.count(F.lit(1)).alias("_rows"))


def finish_sums(
    partial: DataFrame, group_columns: Sequence[str], value_columns: Sequence[str], how: str = "sum"
) -> DataFrame:
    """Rounded values per group from partial sums; equal keys are merged on the way."""
    merge = (lambda c: F.sum(col(c))) if how == "count" else merge_totals
    merged = partial.groupBy(*map(col, group_columns)).agg(
        *[merge(c).alias(c) for c in value_columns]
    )
    return _settled(merged, group_columns, value_columns, how)


def _settled(sums: DataFrame, group_columns, value_columns, how: str) -> DataFrame:
    value = col if how == "count" else settle
    return sums.select(*map(col, group_columns), *[value(c).alias(c) for c in value_columns])


def with_grand_total(
    summary: DataFrame, group_columns: Sequence[str], value_columns: Sequence[str]
) -> DataFrame:
    """Branch rows plus one total row (``row_kind`` = branch / total), no subtotals.

    The total adds up the already rounded branch values, not the input again: both sides
    of the union read one shuffle of partial sums. An empty summary has a total of 0.
    """
    return stack_total(summary, group_columns, totals(summary, value_columns))


def totals(summary: DataFrame, value_columns: Sequence[str]) -> DataFrame:
    """One row: the total of each value column, 0 over no rows."""
    counts = {f.name for f in summary.schema if f.dataType.typeName() == "long"}
    sums = summary.agg(
        *[
            (F.coalesce(F.sum(col(c)), F.lit(0)) if c in counts else money_total(c)).alias(c)
            for c in value_columns
        ]
    )
    return sums.select(*[(col(c) if c in counts else settle(c)).alias(c) for c in value_columns])


def stack_total(rows: DataFrame, group_columns: Sequence[str], total: DataFrame) -> DataFrame:
    """Rows and one total row under them, told apart by ``row_kind``."""
    blanks = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in group_columns]
    labelled = total.select(*blanks, "*", F.lit("total").alias("row_kind"))
    return rows.withColumn("row_kind", F.lit("branch")).unionByName(labelled)


def round_values(df: DataFrame, value_columns: Sequence[str], mode: str = "round") -> DataFrame:
    """Value columns in whole units. Rows and totals round on their own."""
    return df.withColumns({c: whole_units(col(c).cast("double"), mode) for c in value_columns})


def headline(summary: DataFrame, value_column: str) -> DataFrame:
    """One row: the total of the primary value column and the number of branches."""
    values = summary.select(col(value_column).cast("double").alias("v"))
    sums = values.agg(money_total("v").alias("t"), F.count(F.lit(1)).alias("branch_count"))
    return sums.select(settle("t").alias("total_value"), "branch_count")


def report_rows(
    summary: DataFrame,
    group_columns: Sequence[str],
    value_columns: Sequence[str],
    mode: str = "round",
    display: dict[str, str] | None = None,
) -> DataFrame:
    """The summary as reported: rounded, in dashboard order, the total last.

    ``position`` repeats the order as data, since stored tables have none; the total row
    carries its label in the first group column.
    """
    total = F.col("row_kind") == "total"
    rows = round_values(with_grand_total(summary, group_columns, value_columns), value_columns, mode)
    first = group_columns[0]
    place = F.coalesce(branch_position(col(first).cast("string")), F.lit(UNLISTED))
    rows = rows.withColumn("position", F.when(total, F.lit(UNLISTED + 1)).otherwise(place))
    rows = rows.orderBy("position", *map(col, group_columns))
    texts = [c for c in group_columns if rows.schema[c].dataType.typeName() == "string"]
    clean = rows.withColumns({c: strip_control_chars(col(c)) for c in texts}) if texts else rows
    labelled = clean.withColumn(
        first, F.when(total, F.lit(TOTAL_LABEL)).otherwise(col(first).cast("string"))
    )
    out = labelled.select("position", "row_kind", *map(col, group_columns), *map(col, value_columns))
    return out.withColumnsRenamed(display or {})
