"""Reports as lazy plans: filter, look up, aggregate. Nothing here writes or collects,
but for the size check of a lookup side and the choice of a master mapping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ReportValidationError
from ..functions import col, strip_control_chars, whole_units
from ..operators.activity import (
    CATEGORIES,
    CONTEXT_CODE,
    DETAIL_COLUMNS,
    activity_category,
    activity_crosstab,
    crosstab_report,
    roll_up_ids,
    roll_up_pairs,
)
from ..operators.columns import (
    LOOKUP_KEY,
    MAIN_BRANCH,
    MAIN_CODE,
    header_form,
    hide_helpers,
    normalise_key,
    require_columns,
    text_columns,
)
from ..operators.joins import JoinPolicy
from ..operators.lookup import UNMAPPED, attach_branch, fill_unmapped, lookup_branch
from ..operators.mapping import best_mapping, lookup_id, pick_reference
from ..operators.reconcile import pick_balances, write_back
from ..operators.summarize import finish_sums, headline, partial_sums, report_rows, summarize
from .spec import FilterChoice, ReportSpec, resolve_filters

Table = DataFrame | Sequence[tuple[str, DataFrame]]


@dataclass(frozen=True)
class ReportResult:
    """The outputs of a report run, each planned when it is first asked for.

    ``summary`` is what is reported (the updated register for a balance report),
    ``detail`` every surviving row, ``metadata`` the head of the report, ``metrics`` one
    row of counts. ``branches`` are the unrounded branch values. ``kept`` are the rows after
    the filters and ``side`` gives the table that was picked to look them up in.
    """

    spec: ReportSpec
    plans: dict[str, Callable[[], DataFrame]]
    kept: DataFrame | None = None
    side: Callable[[], DataFrame] | None = None

    @cached_property
    def summary(self) -> DataFrame:
        return self.plans["summary"]()

    @cached_property
    def detail(self) -> DataFrame:
        return self.plans["detail"]()

    @cached_property
    def metadata(self) -> DataFrame:
        return self.plans["metadata"]()

    @cached_property
    def metrics(self) -> DataFrame:
        return self.plans["metrics"]()

    @cached_property
    def branches(self) -> DataFrame:
        return self.plans["branches"]()


def _tables(table: Table | None) -> list[tuple[str, DataFrame]]:
    return [("table", table)] if isinstance(table, DataFrame) else list(table or [])


def _need(spec: ReportSpec, table: Table | None, what: str) -> list[tuple[str, DataFrame]]:
    tables = _tables(table)
    if not tables:
        raise ReportValidationError(f"{spec.label} needs a {what}, but none was given")
    return tables


def detail_rows(df: DataFrame, value_columns: Sequence[str] = (), mode: str = "round") -> DataFrame:
    """Rows as the detail output holds them.

    Helper columns are gone, text is free of control characters, value columns are in
    whole units, and NaN is null.
    """
    df = hide_helpers(df)
    shown = {c: strip_control_chars(col(c)) for c in text_columns(df) if c not in value_columns}
    for f in df.schema:
        if f.name in value_columns:
            shown[f.name] = whole_units(col(f.name).cast("double"), mode)
        elif f.dataType.typeName() in ("double", "float"):
            shown[f.name] = F.when(~F.isnan(col(f.name)), col(f.name))
    return df.withColumns(shown) if shown else df


def _metadata(
    title: str, rows: DataFrame, label: str | None, no_label: str, unmapped_ids: bool = False
) -> DataFrame:
    """The head of a report as ``item, value`` rows; ``rows`` has one row of counts."""
    count = lambda c: F.format_number(c, 0)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    items = [
        (F.lit(title), F.lit("")),
        (F.lit("Processing Timestamp:"), stamp),
        (F.lit("Total Records Processed:"), count(F.col("records"))),
        (F.lit("Filter Applied:"), F.lit(label or no_label)),
    ]
    if unmapped_ids:
        items.append((F.lit("Unmapped IDs:"), count(F.col("unmapped"))))
    entries = F.array(*[F.struct(i.alias("item"), v.alias("value")) for i, v in items])
    if unmapped_ids:
        entries = F.when(F.col("unmapped") > 0, entries).otherwise(F.slice(entries, 1, 4))
    return rows.select(F.posexplode(entries).alias("line", "e")).select("line", "e.item", "e.value")


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(col(c)).alias(c) for c in stacked.columns])


def branch_sums(
    kept: DataFrame,
    reference: DataFrame,
    spec: ReportSpec,
    key: str,
    order_by: str | None,
    policy: JoinPolicy,
) -> DataFrame:
    """Partial sums per lookup key, with the key's branch (null where there is none).

    The rows are aggregated before the lookup, not after it: the join sees one row per
    key, so neither a hot key nor a large reference moves the raw rows.
    """
    require_columns(kept, [header_form(key)], spec.label)
    own = [c for c in spec.group_columns if c not in (MAIN_CODE, MAIN_BRANCH)]
    sums = partial_sums(kept, [header_form(key), *own], spec.value_columns, spec.how)
    return attach_branch(sums, reference, key, order_by, policy)


def _summary_report(spec, raw, reference, filters, key, order_by, policy) -> ReportResult:
    kept = filters.apply(raw)
    side = None
    groups, values, mode = spec.group_columns, spec.value_columns, spec.rounding
    if spec.needs_reference:
        _, table = pick_reference(_need(spec, reference, "reference table"), key)
        kept, side = normalise_key(kept, key), lambda: table
        per_key = cache(lambda: branch_sums(kept, table, spec, key, order_by, policy))
        branches = cache(lambda: finish_sums(fill_unmapped(per_key()), groups, values, spec.how))

        def rows() -> DataFrame:
            return lookup_branch(kept, table, key, order_by, policy)

        def counts() -> DataFrame:
            missed = F.sum(F.when(col(MAIN_CODE).isNull(), F.col("_rows")))
            return per_key().agg(
                F.coalesce(F.sum("_rows"), F.lit(0)).alias("records"),
                F.coalesce(missed, F.lit(0)).alias("unmapped"),
            )

    else:
        branches = cache(lambda: summarize(kept, groups, values, spec.how))

        def rows() -> DataFrame:
            return kept

        def counts() -> DataFrame:
            none = F.lit(0).cast("long").alias("unmapped")
            return kept.agg(F.count(F.lit(1)).alias("records"), none)

    def metrics() -> DataFrame:
        return one_row(
            raw.agg(F.count(F.lit(1)).alias("processed_rows")),
            counts().withColumnsRenamed({"records": "kept_rows", "unmapped": "unmapped_rows"}),
            headline(branches(), spec.primary),
        )

    return ReportResult(
        spec,
        {
            "summary": lambda: report_rows(branches(), groups, values, mode, dict(spec.display)),
            "detail": lambda: detail_rows(rows(), values if spec.how == "sum" else (), mode),
            "metadata": lambda: _metadata(spec.title, counts(), filters.label, "None (All Segments)"),
            "metrics": metrics,
            "branches": branches,
        },
        kept,
        side,
    )


def activity_rows(
    kept: DataFrame,
    reference: DataFrame,
    master: Table,
    key: str = LOOKUP_KEY,
    order_by: str | None = None,
    policy: JoinPolicy = JoinPolicy(),
) -> DataFrame:
    """Per id: context code, master code, summed frequency, category.

    The context code belongs to an id's first row. It is looked up per (id, key) pair.
    """
    key = header_form(key)
    pairs = roll_up_pairs(normalise_key(kept, key), key, order_by=order_by)
    coded = fill_unmapped(attach_branch(pairs, reference, key, order_by, policy))
    per_id = roll_up_ids(coded.withColumnRenamed(MAIN_CODE, CONTEXT_CODE), CONTEXT_CODE)
    _, mapping = best_mapping(_tables(master), kept, "ID", order_by)
    coded = lookup_id(per_id, mapping, policy)
    return coded.withColumn("USER_AKTIF", activity_category(F.col("FREKUENSI"))).select(
        *map(col, DETAIL_COLUMNS)
    )


def _activity_report(spec, raw, reference, master, filters, key, order_by, policy) -> ReportResult:
    tables = _need(spec, reference, "reference table")
    masters = _need(spec, master, "master table")
    _, table = pick_reference(tables, key)
    kept = filters.apply(raw)
    per_id = cache(lambda: activity_rows(kept, table, masters, key, order_by, policy))
    crosstab = cache(lambda: activity_crosstab(per_id()))

    def counts() -> DataFrame:
        unmapped = F.count_if(col(MAIN_CODE) == UNMAPPED).alias("unmapped")
        ids = per_id().agg(F.count(F.lit(1)).alias("ids"), unmapped)
        return one_row(raw.agg(F.count(F.lit(1)).alias("records")), ids)

    names = {"records": "processed_rows", "unmapped": "unmapped_ids"}
    return ReportResult(
        spec,
        {
            "summary": lambda: crosstab_report(crosstab()),
            "detail": lambda: detail_rows(per_id(), ("FREKUENSI",)),
            "metadata": lambda: _metadata(spec.title, counts(), filters.label, "None", True),
            "metrics": lambda: counts().withColumnsRenamed(names),
            "branches": crosstab,
        },
        kept,
        lambda: best_mapping(masters, kept, "ID", order_by)[0].frame,
    )


def _balance_report(spec, raw, master, order_by, policy) -> ReportResult:
    register = _need(spec, master, "register to update")
    _, monthly = pick_balances(_tables(raw))
    done = write_back(register[0][1], monthly, order_by, policy)

    def register_rows() -> DataFrame:
        return hide_helpers(done.register)

    def metrics() -> DataFrame:
        names = {"scanned_rows": "processed_rows", "unmatched_rows": "unmapped_rows"}
        return done.counts().withColumnsRenamed(names)

    def metadata() -> DataFrame:
        head = done.counts().select(F.col("scanned_rows").alias("records"))
        return _metadata(spec.title, head, None, "None")

    return ReportResult(
        spec,
        {
            "summary": register_rows,
            "detail": register_rows,
            "branches": register_rows,
            "metadata": metadata,
            "metrics": metrics,
        },
    )


def run_report(
    spec: ReportSpec,
    raw: Table,
    reference: Table | None = None,
    master: Table | None = None,
    choice: FilterChoice | None = None,
    *,
    key: str = LOOKUP_KEY,
    order_by: str | None = None,
    policy: JoinPolicy = JoinPolicy(),
) -> ReportResult:
    """Plan a report over frames. ``raw`` is an extract's data, or any table like it.

    ``reference`` and ``master`` are tables or lists of ``(name, table)`` to choose from.
    ``order_by`` names the row-order column where the frames have no ``_ord``.
    """
    if spec.kind == "balances":
        return _balance_report(spec, raw, master, order_by, policy)
    if not isinstance(raw, DataFrame):
        raise ReportValidationError(f"{spec.label} takes one input table")
    require_columns(raw, spec.required_columns, spec.label)
    filters = resolve_filters(spec, choice)
    if spec.kind == "activity":
        return _activity_report(spec, raw, reference, master, filters, key, order_by, policy)
    return _summary_report(spec, raw, reference, filters, key, order_by, policy)


__all__ = ["CATEGORIES", "ReportResult", "activity_rows", "detail_rows", "run_report"]
