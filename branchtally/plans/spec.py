"""What a report is: its columns, its default filters, and how a run may change them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators.columns import KW_ALIASES
from ..operators.filters import FilterValues, filter_kw, filter_segment, filter_source, filter_values


@dataclass(frozen=True)
class ReportSpec:
    """A report as data. ``kind`` picks the plan: summary, activity or balances."""

    report_id: str
    label: str
    title: str
    group_columns: tuple[str, ...] = ()
    value_columns: tuple[str, ...] = ()
    primary_value: str | None = None
    how: str = "sum"
    rounding: str = "round"
    numeric_columns: tuple[str, ...] = ()
    required_columns: tuple[str, ...] = ()
    display: tuple[tuple[str, str], ...] = ()
    needs_reference: bool = False
    needs_master: bool = False
    kind: str = "summary"
    # Which dimensions a run may filter, and the lists that apply when it does not.
    segment_live: bool = False
    source_live: bool = False
    kw_live: bool = False
    segment_keep: tuple[str, ...] = ()
    segment_drop: tuple[str, ...] = ()
    source_drop: tuple[str, ...] = ()
    kw_keep: tuple[str, ...] = ()
    # Values each dimension is known to hold; they filter nothing by themselves.
    segment_options: tuple[str, ...] = ()
    source_options: tuple[str, ...] = ()
    kw_options: tuple[str, ...] = ()

    @property
    def primary(self) -> str | None:
        return self.primary_value or (self.value_columns[-1] if self.value_columns else None)


@dataclass(frozen=True)
class FilterChoice:
    """Filter lists chosen for one run.

    ``None`` leaves a report's default in place, an empty list switches the filter off,
    values replace the default. Dimensions a report does not expose are ignored.
    """

    segment_keep: FilterValues = None
    segment_drop: Sequence[str] | None = None
    source_keep: Sequence[str] | None = None
    source_drop: Sequence[str] | None = None
    kw_keep: Sequence[str] | None = None

    @classmethod
    def keep_only(
        cls,
        segment: Sequence[str] | None = None,
        source: Sequence[str] | None = None,
        kw: Sequence[str] | None = None,
    ) -> "FilterChoice":
        """Keep-lists that also clear the default drop-list of the same dimension."""
        return cls(
            segment_keep=segment,
            segment_drop=None if segment is None else (),
            source_keep=source,
            source_drop=None if source is None else (),
            kw_keep=kw,
        )


@dataclass(frozen=True)
class ActiveFilters:
    """The lists a run really applies."""

    segment_keep: tuple[str, ...] = ()
    segment_drop: tuple[str, ...] = ()
    source_keep: tuple[str, ...] = ()
    source_drop: tuple[str, ...] = ()
    kw_keep: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        """Source, segment and KW conditions; they run before any lookup."""
        df = filter_source(df, self.source_keep, self.source_drop)
        df = filter_segment(df, self.segment_keep, self.segment_drop)
        return filter_kw(df, self.kw_keep)

    @property
    def label(self) -> str | None:
        """What was filtered, for the head of the report."""
        parts = (
            (self.segment_keep, "only"),
            (self.segment_drop, "excluded"),
            (self.source_keep, "SOURCE only"),
            (self.source_drop, "SOURCE excluded"),
            (self.kw_keep, "KW only"),
        )
        return "; ".join(f"{', '.join(v)} ({what})" for v, what in parts if v) or None


def resolve_filters(spec: ReportSpec, choice: FilterChoice | None = None) -> ActiveFilters:
    """A run's choice over the report's defaults."""
    choice = choice or FilterChoice()

    def pick(live: bool, chosen, default):
        return tuple(filter_values(chosen)) if live and chosen is not None else tuple(default)

    filters = ActiveFilters(
        segment_keep=pick(spec.segment_live, choice.segment_keep, spec.segment_keep),
        segment_drop=pick(spec.segment_live, choice.segment_drop, spec.segment_drop),
    )
    if spec.source_live:
        filters = replace(
            filters,
            source_keep=pick(True, choice.source_keep, ()),
            source_drop=pick(True, choice.source_drop, spec.source_drop),
        )
    if spec.kw_live:
        filters = replace(filters, kw_keep=pick(True, choice.kw_keep, spec.kw_keep))
    return filters


def filter_options(spec: ReportSpec) -> dict[str, tuple[str, ...]]:
    """Known values per exposed dimension."""
    listed = (
        ("SEGMEN", spec.segment_live, spec.segment_options),
        ("SOURCE", spec.source_live, spec.source_options),
        (KW_ALIASES[0], spec.kw_live, spec.kw_options),
    )
    return {name: options for name, live, options in listed if live}
