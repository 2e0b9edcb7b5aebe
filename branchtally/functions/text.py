"""Text expressions: trimming, canonical keys, cell cleanup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col

# Every character Unicode counts as white space. Spark's plain trim only
# removes U+0020, so the set is passed to btrim explicitly.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Cells that exactly equal one of these read as missing.
NULL_TOKENS = ("nan", "None", "NaT")
# Fixed pattern: control characters a workbook cell cannot hold (tab, LF, CR are fine).
CONTROL_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def strip(c: Column) -> Column:
    """Trim all Unicode white space on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def only_spaces(line: Column) -> Column:
    """The line's only white space is U+0020, so a plain trim does for all its cells."""
    ascii_only = F.octet_length(line) == F.length(line)
    others = [w for w in WHITESPACE if w.isascii() and w != " "]
    return reduce(lambda ok, w: ok & ~F.contains(line, F.lit(w)), others, ascii_only)


def fold(c: Column) -> Column:
    """Comparison form of a filter value; a missing cell compares as blank."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def clean_cell(c: Column) -> Column:
    """A raw cell as it enters the data: trimmed, missing and null tokens blank."""
    return blank_missing(strip(c))


def blank_missing(trimmed: Column) -> Column:
    """A trimmed cell with missing values and null tokens as blank."""
    missing = trimmed.isNull() | trimmed.isin(*NULL_TOKENS)
    return F.when(missing, F.lit("")).otherwise(trimmed)


def as_text(df: DataFrame, name: str) -> Column:
    """Column ``name`` as text; whole floating numbers print as ``7.0``, never ``1.2E9``."""
    c = col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e16))
        return F.when(whole, F.concat(d.cast("long").cast("string"), F.lit(".0"))).otherwise(
            d.cast("string")
        )
    if isinstance(kind, T.StringType):
        return c
    return c.cast("string")


def _without_decimal_tail(s: Column) -> Column:
    # The regex runs only on cells that can match it.
    return F.when(
        s.endswith("0") & s.contains(".0"), F.regexp_replace(s, r"^(\d+)\.0+$", "$1")
    ).otherwise(s)


def canonical_id(c: Column) -> Column:
    """Join form of an id: trimmed, ``1001.0`` becomes ``1001``, leading zeros stay."""
    return _without_decimal_tail(strip(c))


def canonical_branch_code(c: Column) -> Column:
    """Ordering form of a branch code: as ``canonical_id``, unpadded and upper case."""
    s = _without_decimal_tail(strip(c))
    return F.upper(
        F.when(s.startswith("0"), F.regexp_replace(s, r"^0+(?=\d+$)", "")).otherwise(s)
    )


def strip_control_chars(c: Column) -> Column:
    """Remove control characters; text without any is passed through unchanged."""
    return F.regexp_replace(c, CONTROL_CHARS, "")
