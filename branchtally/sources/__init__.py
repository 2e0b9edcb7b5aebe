"""Where rows come from and go to: text lines, extracts, reference tables, outputs."""

from .extract import Extract, discover_titles, parse_lines, parse_table, pick_source, read_extract
from .lines import LINE_COLUMNS, lines_from_table, read_lines
from .tables import read_reference_csv
from .sinks import Delivery, write_table

__all__ = [
    "Delivery",
    "Extract",
    "LINE_COLUMNS",
    "discover_titles",
    "lines_from_table",
    "parse_lines",
    "parse_table",
    "pick_source",
    "read_extract",
    "read_lines",
    "read_reference_csv",
    "write_table",
]
