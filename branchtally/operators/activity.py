"""Activity per user id, and the crosstab of active and inactive users per branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_text, canonical_id, col, merge_totals, money_total, settle
from ..functions.text import strip_control_chars
from .columns import MAIN_CODE
from .lookup import UNMAPPED, row_order
from .ordering import UNLISTED, branch_position
from .summarize import TOTAL_LABEL, number_or_zero, stack_total, totals

# Category labels and the activity threshold.
ACTIVE = "AKTIF TRX >=5x"
INACTIVE = "TIDAK AKTIF <5x"
CATEGORIES = (ACTIVE, INACTIVE)
ACTIVE_FROM = 5
# Codes that name no branch.
NO_BRANCH = (UNMAPPED, "", "#N/A")

CONTEXT_CODE = "UKER_MAIN_CODE"
DETAIL_COLUMNS = ("ID", CONTEXT_CODE, MAIN_CODE, "FREKUENSI", "USER_AKTIF")


def roll_up_pairs(
    rows: DataFrame,
    carry: str,
    id_column: str = "ID",
    measure: str = "FREKUENSI",
    order_by: str | None = None,
) -> DataFrame:
    """Per (canonical id, carried value): summed measure ``_t`` and first row ``_o``.

    Its state is of fixed width, so it combines in the map tasks by hash. What a lookup
    or the per-id step then handles is one row per pair, however hot an id is.
    """
    base = rows.select(
        F.coalesce(canonical_id(as_text(rows, id_column)), F.lit("")).alias(id_column),
        as_text(rows, carry).alias(carry),
        number_or_zero(rows, measure).alias("_m"),
        row_order(rows, order_by).alias("_o"),
    )
    return base.groupBy(col(id_column), col(carry)).agg(
        money_total("_m").alias("_t"), F.min("_o").alias("_o")
    )


def roll_up_ids(
    pairs: DataFrame, carry: str, id_column: str = "ID", measure: str = "FREKUENSI"
) -> DataFrame:
    """Per id: the summed measure, and ``carry`` of its first row that has one."""
    first = F.min_by(col(carry), F.when(col(carry).isNotNull(), F.col("_o")))
    merged = pairs.groupBy(col(id_column)).agg(merge_totals("_t").alias("_t"), first.alias(carry))
    return merged.select(col(id_column), settle("_t", None).alias(measure), col(carry))


def activity_category(measure: Column, threshold: float = ACTIVE_FROM) -> Column:
    return F.when(measure >= threshold, F.lit(ACTIVE)).otherwise(F.lit(INACTIVE))


def only_mapped(df: DataFrame, code: str = MAIN_CODE) -> DataFrame:
    """Without rows that belong to no branch."""
    return df.where(~F.coalesce(col(code), F.lit("")).isin(*NO_BRANCH))


def activity_crosstab(
    per_id: DataFrame, code: str = MAIN_CODE, category: str = "USER_AKTIF"
) -> DataFrame:
    """Ids per branch and category. Both categories are always there, zero if empty."""
    counts = [F.count_if(col(category) == c).alias(c) for c in CATEGORIES]
    return only_mapped(per_id, code).groupBy(col(code)).agg(*counts)


def crosstab_report(crosstab: DataFrame, code: str = MAIN_CODE) -> DataFrame:
    """The crosstab with row totals, a total row, and the dashboard order."""
    key = col(code)
    rows = stack_total(crosstab, [code], totals(crosstab, CATEGORIES))
    is_total = F.col("row_kind") == "total"
    place = F.coalesce(branch_position(key.cast("string")), F.lit(UNLISTED))
    rows = rows.withColumn("position", F.when(is_total, F.lit(UNLISTED + 1)).otherwise(place))
    row_total = sum((col(c) for c in CATEGORIES[1:]), col(CATEGORIES[0]))
    return rows.orderBy("position", key).select(
        "position",
        "row_kind",
        F.when(is_total, F.lit(TOTAL_LABEL)).otherwise(strip_control_chars(key.cast("string"))).alias(code),
        *map(col, CATEGORIES),
        row_total.alias(TOTAL_LABEL),
    )
