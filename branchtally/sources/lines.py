"""Text as rows: ``src`` (which file), ``blk`` and ``row`` (where in it), ``line``.

File order is data here (first hit wins, first title row wins), and Spark frames carry
none. ``(src, blk, row)`` restores it: rows inside one file split keep their order, and
splits are ordered by their start offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLUMNS = ("src", "blk", "row", "line")
# Order values of a table that count as one split.
TABLE_BLOCK = 1 << 20

# The byte-to-character pairs in which Windows-1252 differs from
# ISO-8859-1. Derived from the codec, not typed in.
_C1 = range(0x80, 0xA0)
_CP1252 = {}
for _b in _C1:
    try:
        _CP1252[chr(_b)] = bytes([_b]).decode("cp1252")
    except UnicodeDecodeError:
        pass
_UNDEFINED = "".join(chr(b) for b in _C1 if chr(b) not in _CP1252)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines of one or more text files. Bytes are kept as they are; see ``decode``."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def lines_from_table(df: DataFrame, line: Column, order_by: Column, src: Column | None = None) -> DataFrame:
    """Lines held in a table column, ordered by a unique integer column.

    Ranges of ``TABLE_BLOCK`` order values stand for the splits of a file.
    """
    row = order_by.cast("long")
    return df.select(
        (src if src is not None else F.lit("table")).cast("string").alias("src"),
        F.when(row >= 0, row - row % TABLE_BLOCK).otherwise(F.lit(0)).cast("long").alias("blk"),
        row.alias("row"),
        line.alias("line"),
    )


def line_traits(line: Column) -> Column:
    """What one line's bytes rule out: ``ascii``, ``utf-8``, ``utf-8 only``, ``cp1252``, ``latin-1``.

    ``utf-8 only`` is valid UTF-8 whose bytes Windows-1252 does not define.
    """
    valid = F.is_valid_utf8(line)
    as_latin = F.decode(line.cast("binary"), "ISO-8859-1")
    undefined = F.rlike(as_latin, F.lit(f"[{_UNDEFINED}]"))
    return (
        F.when(valid & (F.octet_length(line) == F.length(line)), F.lit("ascii"))
        .when(valid, F.when(undefined, F.lit("utf-8 only")).otherwise(F.lit("utf-8")))
        .when(undefined, F.lit("latin-1"))
        .otherwise(F.lit("cp1252"))
    )


def file_encoding(seen: Column) -> Column:
    """The encoding of a whole file, from the set of its lines' traits."""
    has = lambda trait: F.array_contains(seen, trait)
    return (
        F.when(~has("cp1252") & ~has("latin-1"), F.lit("utf-8"))
        .when(has("latin-1") | has("utf-8 only"), F.lit("latin-1"))
        .otherwise(F.lit("cp1252"))
    )


def from_latin(text: Column, encoding: str) -> Column:
    """Text that was read as ISO-8859-1, under the encoding it is really in."""
    if encoding != "cp1252":
        return text
    return F.translate(text, "".join(_CP1252), "".join(_CP1252.values()))


def decode_line(line: Column, encoding: Column | str) -> Column:
    """The line's text under a file encoding. UTF-8 lines pass through untouched."""
    as_latin = F.decode(line.cast("binary"), "ISO-8859-1")
    as_cp1252 = from_latin(as_latin, "cp1252")
    if isinstance(encoding, str):
        if encoding not in ("utf-8", "cp1252", "latin-1"):
            raise ValueError(f"unknown encoding {encoding!r}")
        return {"utf-8": line, "cp1252": as_cp1252, "latin-1": as_latin}[encoding]
    return (
        F.when(encoding == "utf-8", line)
        .when(encoding == "cp1252", as_cp1252)
        .otherwise(as_latin)
    )
