"""Which physical column plays which part. Works on names only; starts no job."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnResolutionError, ReportValidationError
from ..functions import as_text, col, header_form, strip

# Accepted header spellings, best first. A header that says "code" ranks
# above a bare one, because extracts can carry both a branch code and a branch name.
LOOKUP_KEY = "KODE_UKER"
LOOKUP_KEY_ALIASES = (
    "KODE_UKER", "KODE_UNIT", "KODE UNIT", "KANCA",
    "KODE SUB KANCA", "KODE KANCA", "KODE UKER", "UKER",
)
MAIN_CODE = "MAIN_CODE"
MAIN_CODE_ALIASES = (
    "MAIN_CODE", "MAIN CODE", "MAIN_CO", "KODE",
    "KODE KANCA", "KODE UNIT", "UNIQUE CODE", "KODE INDUK",
)
MAIN_BRANCH = "MAIN_BRANCH"
MAIN_BRANCH_ALIASES = (
    "MAIN_BRANCH", "MAIN BRANCH", "BRANCH", "DESC KANCA",
    "DESC UNIT", "SUB KANCA", "NAMA UKER", "DESCRIPTION",
)
ID_ALIASES = (
    "ID", "ID PRODUCT", "ID_PRODUCT", "ID USER", "USER ID",
    "USERID", "ID QLOLA", "CIF", "NO REKENING",
)
KW_ALIASES = ("KW", "PRODUCT", "GROUP_PRODUCT", "KAWIL")
ACCOUNT_ALIASES = (
    "NO REK", "NO_REK", "NOREK", "NO REKENING",
    "NO_REKENING", "NOMOR REKENING", "REKENING",
)
TYPE_ALIASES = ("JENIS", "JENIS REKENING", "TIPE")
BALANCE_ALIASES = ("SALDO IDR", "SALDO_IDR", "SALDO IN IDR", "SALDO_IN_IDR", "SALDO")
TARGET_ALIASES = ("SALDO UPDATE", "SALDO_UPDATE")
TARGET_COLUMN = "SALDO UPDATE"
# Month names a balance column can carry.
MONTHS = (
    "JANUARI", "FEBRUARI", "MARET", "APRIL", "MEI", "JUNI",
    "JULI", "AGUSTUS", "SEPTEMBER", "OKTOBER", "NOVEMBER", "DESEMBER",
    "JANUARY", "FEBRUARY", "MARCH", "MAY", "JUNE", "JULY", "AUGUST", "OCTOBER", "DECEMBER",
)
_MONTH_COLUMN = re.compile(r"SALDO[_\s]+([A-Z]+)")


def aliased_columns(columns: Sequence[str], aliases: Sequence[str]) -> list[str]:
    """Every column an alias names, in alias order; of equal headers the first counts."""
    physical = {header_form(c): c for c in reversed(list(columns))}
    hits = [physical[a] for a in map(header_form, aliases) if a in physical]
    return list(dict.fromkeys(hits))


def resolve_alias(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The column of the best-ranked alias that is present, or None."""
    return next(iter(aliased_columns(columns, aliases)), None)


def key_aliases(key: str = LOOKUP_KEY) -> tuple[str, ...]:
    """Spellings of the lookup key, the configured one first."""
    return tuple(dict.fromkeys((header_form(key), *LOOKUP_KEY_ALIASES)))


def rename_alias(df: DataFrame, aliases: Sequence[str], name: str) -> DataFrame:
    """Rename the column an alias resolves to; unchanged when ``name`` is there already."""
    found = name if name in df.columns else resolve_alias(df.columns, aliases)
    return df if found in (None, name) else df.withColumnRenamed(found, name)


def reference_names(columns: Sequence[str], key: str = LOOKUP_KEY) -> dict[str, str]:
    """Key, code and branch of a reference table as ``{logical: physical}``.

    They are chosen in turn and a chosen column is out of the running for the next, so
    one column never plays two parts.
    """
    key = header_form(key)
    wanted = (
        (key, key_aliases(key)),
        (MAIN_CODE, MAIN_CODE_ALIASES),
        (MAIN_BRANCH, MAIN_BRANCH_ALIASES),
    )
    current = {c: c for c in columns}  # name after the renames so far -> physical column
    chosen: dict[str, str] = {}
    for logical, aliases in wanted:
        found = resolve_alias(list(current), aliases)
        if found is None:
            continue
        chosen[logical] = current[found]
        current = {logical if name == found else name: c for name, c in current.items()}
    return chosen


def rename_reference(df: DataFrame, key: str = LOOKUP_KEY) -> DataFrame:
    """A reference table under its logical names; an error names what is missing."""
    names = reference_names(df.columns, key)
    missing = [n for n in (header_form(key), MAIN_CODE, MAIN_BRANCH) if n not in names]
    if missing:
        raise ColumnResolutionError(unresolved_reference({"reference": df.columns}, key))
    # A column already bearing a logical name it does not play would clash.
    taken = {n for n, c in names.items() if n != c}
    df = df.drop(*[c for c in df.columns if c in taken and c not in names.values()])
    return df.withColumnsRenamed({c: n for n, c in names.items() if n != c})


def unresolved_reference(tables: dict[str, Sequence[str]], key: str = LOOKUP_KEY) -> str:
    seen = "\n".join(f"  {name}: {list(cols)}" for name, cols in tables.items())
    return (
        f"no table has columns for the lookup key {header_form(key)!r}, {MAIN_CODE!r} and "
        f"{MAIN_BRANCH!r}.\nTables looked at:\n{seen}\nAccepted headers:\n"
        f"  key: {list(key_aliases(key))}\n  {MAIN_CODE}: {list(MAIN_CODE_ALIASES)}\n"
        f"  {MAIN_BRANCH}: {list(MAIN_BRANCH_ALIASES)}"
    )


def normalise_key(df: DataFrame, key: str = LOOKUP_KEY) -> DataFrame:
    """The lookup key under its own name, as trimmed text. Without one, unchanged."""
    key = header_form(key)
    df = rename_alias(df, key_aliases(key), key)
    if key not in df.columns:
        return df
    return df.withColumn(key, F.coalesce(strip(as_text(df, key)), F.lit("")))


def require_columns(df: DataFrame, required: Sequence[str], label: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ReportValidationError(
            f"{label} needs column(s) {missing}, absent from the input. "
            f"Available columns: {[c for c in df.columns if not c.startswith('_')]}"
        )


def target_column(columns: Sequence[str]) -> str:
    """Where a register takes new balances.

    ``SALDO UPDATE`` if there, else the right-most ``SALDO <month>``, else a new
    ``SALDO UPDATE``. Plain ``SALDO`` is history and never a target.
    """
    named = resolve_alias(columns, TARGET_ALIASES)
    if named is not None:
        return named
    monthly = [
        c for c in columns
        if (m := _MONTH_COLUMN.fullmatch(header_form(c))) and m.group(1) in MONTHS
    ]
    return monthly[-1] if monthly else TARGET_COLUMN


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string"]


def hide_helpers(df: DataFrame) -> DataFrame:
    """Without the row-order and other helper columns."""
    return df.select(*[col(c) for c in df.columns if not c.startswith("_")])
