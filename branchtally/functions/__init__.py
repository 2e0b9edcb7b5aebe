"""Column expressions. Everything here is built from Spark's own functions."""

from .names import ORD, col, header_form, quoted, text_list, unique_headers
from .numbers import (
    merge_totals,
    money_total,
    parse_balance,
    parse_number,
    settle,
    whole_units,
)
from .text import (
    as_text,
    blank_missing,
    canonical_branch_code,
    canonical_id,
    clean_cell,
    fold,
    only_spaces,
    strip,
    strip_control_chars,
)

__all__ = [
    "ORD",
    "as_text",
    "blank_missing",
    "canonical_branch_code",
    "canonical_id",
    "clean_cell",
    "col",
    "fold",
    "header_form",
    "merge_totals",
    "money_total",
    "only_spaces",
    "parse_balance",
    "parse_number",
    "quoted",
    "settle",
    "strip",
    "strip_control_chars",
    "text_list",
    "unique_headers",
    "whole_units",
]
