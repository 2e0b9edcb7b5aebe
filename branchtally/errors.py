"""Errors a run can end with. Each says what was missing and what was available."""

from __future__ import annotations


class ExtractError(Exception):
    """The raw input cannot be read as a table."""


class EmptyInputError(ExtractError):
    """The raw input has no data rows; nothing may be written."""

    def __init__(self, detail: str = ""):
        message = (
            "The input is empty: it has no data rows (only column titles, or nothing "
            "at all). Nothing was processed."
        )
        super().__init__(f"{message} {detail}".strip())


class ColumnResolutionError(Exception):
    """A logical column matched none of its accepted header spellings."""


class ReportValidationError(Exception):
    """A report was asked for with an unknown id, a missing input or missing columns."""
