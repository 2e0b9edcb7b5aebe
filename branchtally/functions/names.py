"""Header names: comparison form, quoting, de-duplication. Driver-side metadata only."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = re.compile("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")

# Row order, where a frame carries one: any orderable type, unique per row.
ORD = "_ord"


def quoted(name: str) -> str:
    """A column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column reference that survives dots and spaces in the header text."""
    return F.col(quoted(name))


def text_list(values: Iterable[str]) -> str:
    """String literals for SQL text, separated by commas."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def header_form(name: object) -> str:
    """Comparison form of a header: trimmed, upper case."""
    return str(name).strip().upper()


def unique_headers(names: Iterable[object]) -> list[str]:
    """Comparison forms made unique: blanks get a position name, repeats a numeric tail.

    Control characters are left out, as in the cells of every output.
    """
    taken: set[str] = set()
    out: list[str] = []
    for position, raw in enumerate(names):
        base = header_form(_CONTROL.sub("", str(raw))) or f"UNNAMED: {position}"
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}.{n}"
        taken.add(name)
        out.append(name)
    return out
