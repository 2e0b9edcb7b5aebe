"""Delimited extracts: find the title row wherever it is, parse around it, clean cells.

Two passes over the text. The first is one aggregate with a few values per file split: which
encoding reads the whole file, where its title row is and how many lines are above it, and
whether quoted cells hold line breaks. The second parses. Neither sorts or shuffles lines; only
files with line breaks in cells are read as records first (``records``).

Each source has a layout of its own: where in its rows each column of the whole extract stands.
Layouts are data next to the lines, so any number of them parses like one.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmptyInputError, ExtractError
from ..functions import (
    ORD,
    blank_missing,
    col,
    header_form,
    only_spaces,
    parse_number,
    quoted,
    strip,
    text_list,
    unique_headers,
)
from ..operators.joins import fits_broadcast, left_lookup
from ..session import has_checkpoint_dir
from .local import local_frame
from .lines import decode_line, file_encoding, line_traits, read_lines
from .records import opens_quote, stored, whole_records

# Cells that mark a row as column titles (two exact hits are enough).
TITLE_HINTS = (
    "KODE_UKER", "KODE UKER", "KODE_UNIT", "KODE UNIT", "KANCA",
    "MAINBR", "MBNAME", "MBDESC", "BRNAME", "MAIN_CODE", "MAIN_BRANCH",
    "AMOUNT_IN_IDR", "AMOUNT_ORI", "AMOUNT",
    "VOLUME_IN_IDR", "VOLUME_IDR", "VOLUME", "VOL",
    "SEGMEN", "FBI", "SOURCE", "ID", "FREKUENSI", "TAHUN", "PERIODE", "REGION",
    "CUST_NAME", "CUSTOMER_NAME", "CUSTOMER_CIF",
    "NO REK", "SALDO IDR", "SALDO UPDATE", "KW", "ID_PRODUCT", "BRANCH", "DIVISI",
    "NOMOR_BG", "CURRENCY", "STATUS", "ISSUEDATE", "PNRM", "RMNAME",
)
TITLE_SCORE = 2
MIN_FILLED_CELLS = 2
# Cells read as empty when a row's filled cells are counted.
EMPTY_LOOKALIKES = ("", "NAN", "NONE", "NAT", "<NA>", "NATYPE")

# Up to this many files, per-file facts are held on the driver (one small row each); the facts
# of more are stored and joined. Both are made by the same functions.
MAX_LOCAL_FILES = 10_000

_END = "\x01"


@dataclass(frozen=True)
class Extract:
    """A parsed extract. ``tagged`` holds every line with the verdict on it."""

    tagged: DataFrame
    columns: tuple[str, ...]
    numeric_columns: tuple[str, ...] = ()
    titles: DataFrame | None = field(default=None, repr=False)
    counted: dict[str, int] | None = None

    @property
    def data(self) -> DataFrame:
        """Kept rows: text cells trimmed, numeric columns parsed, plus ``_ord``."""
        kept = self.tagged.where(F.col("_verdict") == "data")
        cells = [
            parse_number(col(c)).alias(c) if c in self.numeric_columns else col(c)
            for c in self.columns
        ]
        return kept.select(*cells, F.struct("src", "blk", "row").alias(ORD))

    @property
    def rejects(self) -> DataFrame:
        """Rows with more fields than titles, as they were read."""
        return self.tagged.where(F.col("_verdict") == "malformed").select(
            "src", "blk", "row", F.col("_raw").alias("line")
        )

    def metrics(self) -> DataFrame:
        """One row per source: rows kept and malformed, and the 1-based title row."""
        return self._by_source().drop("titles")

    def _by_source(self) -> DataFrame:
        v = F.col("_verdict")
        # lines above the titles were counted when the titles were found, however the file was
        # split; only rows numbered by a table with gaps are counted here, by their numbers
        before = F.struct("blk", "row") < F.struct("_title_blk", "_title_row")
        counted = F.coalesce(F.max("_header_row"), F.count_if(before) + 1)
        header_row = F.when(F.max("_promoted"), counted).otherwise(F.lit(1).cast("long"))
        return self.tagged.groupBy("src").agg(
            F.count_if(v == "data").alias("total_rows"),
            F.count_if(v == "malformed").alias("malformed_rows"),
            header_row.alias("header_row"),
            F.count_if(v == "title").alias("titles"),
        )

    def ingest(self) -> tuple[int, int]:
        """(malformed rows, largest title row); refuses sources whose title row was not met again.

        Titles are found in one pass and met in the next. Should a source's lines have changed
        or been numbered otherwise in between, this fails instead of reading titles as data.
        """
        found = self._by_source().agg(
            F.count_if(F.col("titles") == 0).alias("lost"),
            F.sum("malformed_rows").alias("m"),
            F.max("header_row").alias("h"),
        ).first()
        if found["lost"]:
            raise ExtractError(f"the title rows of {found['lost']} sources were not met again")
        return found["m"] or 0, found["h"] or 1

    def stored(self, path: str) -> "Extract":
        """The same extract, its lines parsed once and kept as parquet at ``path``.

        What becomes of the lines is counted along with the write.
        """
        v = F.col("_verdict")
        counts = {name: F.count_if(v == name).alias(name) for name in ("data", "malformed")}
        watched = Observation()
        raw = F.when(v == "malformed", F.col("_raw")).alias("_raw")  # only rejects are shown as they were read
        kept = self.tagged.select(*[raw if c == "_raw" else col(c) for c in self.tagged.columns if c != "_same"])
        kept.observe(watched, *counts.values()).write.parquet(path)
        tagged = self.tagged.sparkSession.read.schema(kept.schema).parquet(path)
        return replace(self, tagged=tagged, counted=watched.get)

    def require_rows(self) -> "Extract":
        """Refuse an extract without data rows, before anything is written."""
        if self.counted is not None:
            if not self.counted["data"]:
                raise EmptyInputError()
            return self
        if self.tagged.where(F.col("_verdict") == "data").isEmpty():
            raise EmptyInputError()
        return self


def header_note(header_row: int) -> str | None:
    """What to tell the operator when a file did not begin with its titles."""
    return None if header_row <= 1 else f"Titles on row {header_row}; the rows around it are in the output."


def hint_set(extra: Sequence[str] = ()) -> list[str]:
    return sorted({h for h in map(header_form, (*TITLE_HINTS, *extra)) if h})


def title_score(cells: Column, hints: Sequence[str]) -> Column:
    """How many cells of a row are exactly a known title."""
    known = F.expr(f"array({text_list(hints)})")
    return F.size(F.filter(cells, lambda c: F.array_contains(known, F.upper(strip(c)))))


def _may_be_title(line: Column, delimiter: str, hints: Sequence[str]) -> Column:
    """Cheap and never wrong in saying no: some cell of the line is a known title.

    Looks only where a cell begins, so long cells cost little. Counting cells one by one is
    left for the few lines that pass.
    """
    blank = r"[\s\p{Z}\x1c-\x1f\x85]*+"
    begin, titles = re.escape(delimiter), "|".join(map(re.escape, hints))
    return F.rlike(F.upper(line), F.lit(rf"(?:^|{begin}){blank}(?:{titles}){blank}(?:{begin}|\z)"))


def _split(line: Column, delimiter: str) -> Column:
    return F.split(line, re.escape(delimiter), -1)


def discover_titles(
    lines: DataFrame, delimiter: str = "|", hints: Sequence[str] = (), encoding: str | None = None
) -> DataFrame:
    """One row per source: encoding, the title line, where it is, and if it was matched.

    The title row is the first whose cells hit two known titles, however deep; without
    one it is the first line that is not blank. ``hints`` extend the known titles.
    """
    line, known = F.col("line"), hint_set(hints)
    is_title = title_score(_split(line, delimiter), known) >= TITLE_SCORE
    found = _discover(
        lines,
        payload=line,
        scored=F.when(_may_be_title(line, delimiter, known), is_title).otherwise(F.lit(False)),
        filled=strip(line) != "",
        traits=F.lit("ascii") if encoding else line_traits(line),
        encoding=encoding,
        opens=opens_quote(line, delimiter),
    )
    return found.withColumn("title", decode_line(F.col("title"), F.col("encoding")))


def _discover(frame, payload, scored, filled, traits, encoding=None, opens=None) -> DataFrame:
    place = F.struct("blk", "row")
    here = F.struct("blk", "row", "payload")
    span = F.col("span").cast("long") if "span" in frame.columns else F.lit(1).cast("long")
    # A level of its own: each of these is computed once per line.
    facts = frame.select(
        "src",
        "blk",
        "row",
        span.alias("span"),
        payload.alias("payload"),
        filled.alias("filled"),
        traits.alias("traits"),
        scored.alias("scored"),
        (F.lit(False) if opens is None else opens).alias("opens"),
    )
    # collect_set sees at most five values; it also makes this an object-hash aggregate,
    # so lines are not sorted by source to find the first one.
    splits = facts.groupBy("src", "blk").agg(
        F.collect_set("traits").alias("traits"),
        F.min_by(here, F.when(F.col("scored"), place)).alias("matched"),
        F.min_by(here, F.when(F.col("filled"), place)).alias("first_filled"),
        F.min("row").alias("first_row"),
        (F.max(F.col("row") + F.col("span")) - F.min("row")).alias("extent"),
        F.sum("span").alias("lines"),
        F.count_if("opens").alias("opens"),
    )
    found = splits.groupBy("src").agg(
        F.array_distinct(F.flatten(F.collect_set("traits"))).alias("traits"),
        F.min_by("matched", F.col("matched.blk")).alias("matched"),
        F.min_by("first_filled", F.col("first_filled.blk")).alias("first_filled"),
        F.min(F.struct("blk", F.col("first_row").alias("row"))).alias("first"),
        F.collect_list(F.struct("blk", "first_row", "extent", "lines")).alias("splits"),
        F.sum("opens").alias("opens"),
    )
    # columns of their own: names in the last select must not hide what it reads
    titled = found.withColumn("at", F.coalesce("matched", "first_filled")).where(F.col("at").isNotNull())
    numbered = titled.withColumns({"line": _line_number(F.col("at"), F.col("splits")), "hit": F.col("matched").isNotNull()})
    enc = F.lit(encoding) if encoding else file_encoding(F.col("traits"))
    return numbered.select(
        "src",
        enc.alias("encoding"),
        F.col("at.payload").alias("title"),
        F.col("at.blk").alias("title_blk"),
        F.col("at.row").alias("title_row"),
        F.col("hit").alias("matched"),
        (F.col("hit") & (F.struct("at.blk", "at.row") > F.col("first"))).alias("promoted"),
        F.col("line").alias("header_row"),
        (F.col("opens") > 0).alias("line_breaks"),
    )


def _line_number(place: Column, splits: Column) -> Column:
    """The 1-based line of a place in its file, for any splits: lines of the splits above it, and its own.

    In a split without gaps the row numbers count its lines; in one with gaps there is no number.
    """
    above = F.filter(splits, lambda s: s["blk"] < place["blk"])
    lines = F.aggregate(above, F.lit(0).cast("long"), lambda total, s: total + s["lines"])
    own = F.filter(splits, lambda s: s["blk"] == place["blk"])[0]
    return F.when(own["extent"] == own["lines"], lines + place["row"] - own["first_row"] + 1)


def _parse_cells(line: Column, delimiter: str, width: int) -> Column:
    """Fields of a line as an array. Only lines with a quote need the CSV parser.

    The parser gets an end marker as an extra last field, which makes the number of
    fields exact: short rows, long rows and trailing empty fields all stay apart.
    """
    schema = ", ".join(f"c{i} string" for i in range(width + 2))
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    record = F.from_csv(F.concat(line, F.lit(delimiter + _END)), schema, options)
    # Bound to a lambda variable, the record is parsed once however often it is named.
    fields = F.transform(
        F.array(record), lambda r: F.array(*[r.getField(f"c{i}") for i in range(width + 2)])
    )
    quoted = F.transform(
        fields, lambda a: F.slice(a, F.lit(1), _fields_before_end(F.array_position(a, F.lit(_END)), width))
    )[0]
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(_split(line, delimiter))


def _fields_before_end(end: Column, width: int) -> Column:
    # No end marker among the parsed fields: the row is longer than any title row.
    return F.when(end > 0, end - 1).otherwise(F.lit(width + 2)).cast("int")


def parse_lines(
    lines: DataFrame,
    *,
    delimiter: str = "|",
    numeric_columns: Sequence[str] = (),
    title_hints: Sequence[str] = (),
    encoding: str | None = None,
) -> Extract:
    """Parse text lines (``src, blk, row, line``) into an extract.

    ``encoding`` skips the detection when the files are known to be in one encoding.
    """
    hints = hint_set(title_hints)
    settled = _settle_titles(discover_titles(lines, delimiter, title_hints, encoding), delimiter)
    broken = settled.with_line_breaks()
    if broken is not None:
        side = F.broadcast(broken) if fits_broadcast(broken) else broken
        records = whole_records(lines, delimiter, broken)
        others = lines.join(side, "src", "left_anti").withColumn("span", F.lit(1))
        again = discover_titles(records, delimiter, title_hints, encoding)
        lines = others.unionByName(records)
        settled = _settle_titles(settled.found.where("not line_breaks").unionByName(again), delimiter)
    return _assemble(lines, settled, delimiter, numeric_columns, hints)


def parse_table(
    frame: DataFrame,
    *,
    order_by: str,
    numeric_columns: Sequence[str] = (),
    title_hints: Sequence[str] = (),
) -> Extract:
    """Parse a table without usable column names, its title row somewhere in the data.

    This is a worksheet loaded cell by cell: every column but ``order_by`` is a cell.
    Stray titles and one-cell banners are always dropped.
    """
    cells = [c for c in frame.columns if c != order_by]
    rows = frame.select(
        F.lit("table").alias("src"),
        F.lit(0).cast("long").alias("blk"),
        col(order_by).cast("long").alias("row"),
        F.array(*[col(c).cast("string") for c in cells]).alias("line"),
    )
    titles = _discover(
        rows,
        payload=F.col("line"),
        scored=title_score(F.col("line"), hint_set(title_hints)) >= TITLE_SCORE,
        filled=F.lit(True),
        traits=F.lit("ascii"),
        encoding="utf-8",
    ).withColumn("promoted", F.lit(True))
    return _assemble(rows, _settle_titles(titles, None), None, numeric_columns, hint_set(title_hints))


@dataclass(frozen=True)
class _Titles:
    """Per-source title facts, and the column titles of each layout among them.

    ``rows`` holds the facts on the driver where they are few, ``facts`` the ones of the lines.
    """

    found: DataFrame
    rows: list | None
    layouts: list[tuple[str, ...]]
    facts: DataFrame
    columns: tuple[str, ...]

    @property
    def any_promoted(self) -> bool:
        return self.rows is None or any(r["promoted"] for r in self.rows)

    def with_line_breaks(self) -> DataFrame | None:
        """The sources (``src``) with line breaks in quoted cells, None without any."""
        if self.rows is None:
            broken = self.found.where("line_breaks").select("src")
            return None if broken.isEmpty() else broken
        names = [(r["src"],) for r in self.rows if r["line_breaks"]]
        return local_frame(self.found.sparkSession, names, "src string") if names else None


def _one_text(title) -> str:
    """A title row as one text: a line as it is, cells with a separator between."""
    return title if isinstance(title, str) else _END.join(c for c in title if c is not None)


def _line_text(line: Column, delimiter: str | None) -> Column:
    """``_one_text`` of a line in a frame."""
    return line if delimiter else F.concat_ws(_END, line)


def _title_fields(title, delimiter: str | None) -> list[str]:
    """The header texts of one title row."""
    if delimiter is None:
        return [name or "" for name in title]
    if len(delimiter) > 1:
        return title.split(delimiter)
    csv.field_size_limit(max(csv.field_size_limit(), len(title) + 1))  # a title may be as long as it is
    return next(csv.reader(io.StringIO(title, newline="\n"), delimiter=delimiter), [""])


def _settle_titles(titles: DataFrame, delimiter: str | None) -> _Titles:
    """Run the discovery once and keep its result: on the driver, or stored.

    Every different title row becomes one layout, parsed here by one parser: how many fields
    its rows may have and, for each column of the extract, which field it is.
    """
    spark = titles.sparkSession
    kept = has_checkpoint_dir(spark)
    if kept:  # the text is read once, however many files turn out to be there
        titles = stored(titles, "titles")
    rows = titles.limit(MAX_LOCAL_FILES + 1).collect()
    if len(rows) <= MAX_LOCAL_FILES:
        found = local_frame(spark, [tuple(r) for r in rows], titles.schema)
        first = {}
        for r in sorted(rows, key=lambda r: r["src"]):
            first.setdefault(_one_text(r["title"]), r["title"])
    else:
        rows = None
        found = titles if kept else stored(titles, "titles")
        text = _line_text(F.col("title"), delimiter)
        kinds = found.groupBy(text.alias("text")).agg(F.min("src").alias("src"), F.first("title").alias("title"))
        first = {r["text"]: r["title"] for r in kinds.orderBy("src").collect()}
    layouts = {text: _title_fields(title, delimiter) for text, title in first.items()}
    headers = {text: unique_headers(n or "" for n in names) for text, names in layouts.items()}
    columns = tuple(dict.fromkeys(name for names in headers.values() for name in names))
    places = {text: {name: i for i, name in reversed(list(enumerate(names)))} for text, names in headers.items()}
    table = [(text, len(names), [places[text].get(c, -1) for c in columns]) for text, names in layouts.items()]
    known = local_frame(spark, table, "_title string, _width int, _at array<int>")
    described = found.select(
        "src",
        F.col("encoding").alias("_encoding"),
        F.col("title_blk").alias("_title_blk"),
        F.col("title_row").alias("_title_row"),
        F.col("promoted").alias("_promoted"),
        F.col("header_row").alias("_header_row"),
        _line_text(F.col("title"), delimiter).alias("_title"),
    )
    facts = left_lookup(described, known, "_title")
    return _Titles(found, rows, [tuple(n) for n in layouts.values()], facts, columns)


def _with_titles(lines: DataFrame, titles: _Titles) -> DataFrame:
    """Put each source's title facts next to its lines; sources without any titles go.

    One source (the usual run) needs no join: its facts are literals. Many sources join
    on the source name, by broadcast when the facts were few enough for the driver. Beyond
    that the lookup decides, which keeps a source with a large share of the lines in place.
    """
    if titles.rows is None:
        return left_lookup(lines, titles.facts, "src").where(F.col("_title").isNotNull())
    if len(titles.rows) > 1:
        return lines.join(F.broadcast(titles.facts), "src")
    (row,) = titles.facts.collect()
    kinds = titles.facts.schema
    facts = {name: F.lit(row[name]).cast(kinds[name].dataType) for name in kinds.names if name not in ("src", "_at")}
    at = F.expr("array(" + ", ".join(f"{i}" for i in row["_at"]) + ")")
    return lines.where(F.col("src") == row["src"]).withColumns(facts | {"_at": at})


def _assemble(lines, settled, delimiter, numeric_columns, hints) -> Extract:
    if not settled.layouts:
        raise EmptyInputError()
    if any(all(not header_form(n or "") for n in names) for names in settled.layouts):
        raise ExtractError("the extract has no column titles")
    columns = settled.columns
    width = max(len(names) for names in settled.layouts)

    raw = decode_line(F.col("line"), F.col("_encoding")) if delimiter else F.col("line")
    cells = _parse_cells(F.col("_raw"), delimiter, width) if delimiter else F.col("_raw")
    plain = only_spaces(F.col("_raw")) if delimiter else F.lit(False)
    fields = (
        _with_titles(lines, settled)
        .withColumn("_raw", raw)
        .withColumns({"_cells": cells, "_plain": plain})
    )
    same = (_line_text(F.col("_raw"), delimiter) == F.col("_title")).alias("_same")
    meta = ["src", "blk", "row", "_raw", "_title_blk", "_title_row", "_promoted", "_header_row", same]
    values = [_value_of(j, settled).alias(name) for j, name in enumerate(columns)]
    trimmed = fields.select(*meta, (F.size("_cells") > F.col("_width")).alias("_long"), *values)
    clean = trimmed.withColumns({name: blank_missing(col(name)) for name in columns})
    return Extract(
        tagged=clean.withColumn("_verdict", _verdict(columns, hints, settled.any_promoted)),
        columns=columns,
        numeric_columns=tuple(c for c in map(header_form, numeric_columns) if c in columns),
        titles=settled.found,
    )


def _value_of(j: int, settled: _Titles) -> Column:
    """The trimmed cell of column ``j``, at the position that the row's own layout has it at."""
    if len(settled.layouts) == 1:  # every column is there, in order
        names = unique_headers(n or "" for n in settled.layouts[0])
        return _trimmed(F.get("_cells", F.lit(names.index(settled.columns[j]))))
    at = F.get("_at", F.lit(j))
    return _trimmed(F.when(at >= 0, F.get("_cells", at)).otherwise(F.lit("")))


def _trimmed(cell: Column) -> Column:
    return F.when(F.col("_plain"), F.trim(cell)).otherwise(strip(cell))


def _count_cells(columns: Sequence[str], condition: str, values: Sequence[str]) -> Column:
    """How many cells, in upper case, are (not) among ``values``."""
    listed = text_list(values)
    return F.expr(" + ".join(f"int(upper({quoted(c)}) {condition} ({listed}))" for c in columns))


def _banner(columns: Sequence[str], hints: Sequence[str]) -> Column:
    """A repeated title row, or a line of text above or between the rows."""
    titles = _count_cells(columns, "IN", hints) >= TITLE_SCORE
    return titles | (_count_cells(columns, "NOT IN", EMPTY_LOOKALIKES) < MIN_FILLED_CELLS)


def _verdict(columns: list[str], hints: Sequence[str], banners: bool) -> Column:
    blank = reduce(lambda a, b: a & b, [col(c) == "" for c in columns])
    # A title below other lines is known by its text, wherever the file was split this time;
    # its exact repeats go with it. A title on the first line may be repeated as data, and
    # only there is the place asked as well.
    place = (F.col("blk") == F.col("_title_blk")) & (F.col("row") == F.col("_title_row"))
    is_title = F.col("_same") & (F.col("_promoted") | place)
    # A partition id is never negative. Naming it keeps the optimizer from copying the
    # whole parse into every filter on the verdict; cells are computed once per line.
    verdict = (
        F.when(F.spark_partition_id() < 0, F.lit(None))
        .when(is_title, F.lit("title"))
        .when(F.col("_long"), F.lit("malformed"))
    )
    if banners:
        verdict = verdict.when(F.col("_promoted") & _banner(columns, hints), F.lit("banner"))
    return verdict.when(blank, F.lit("blank")).otherwise(F.lit("data"))


def read_extract(
    spark: SparkSession,
    paths: str | list[str],
    *,
    delimiter: str = "|",
    numeric_columns: Sequence[str] = (),
    title_hints: Sequence[str] = (),
    encoding: str | None = None,
) -> Extract:
    """Read delimited text files; each file's own title row is found and removed.

    Quoted cells may hold line breaks; files with such cells are stored once as records.
    """
    return parse_lines(
        read_lines(spark, paths),
        delimiter=delimiter,
        numeric_columns=numeric_columns,
        title_hints=title_hints,
        encoding=encoding,
    )


def pick_source(
    candidates: Sequence[tuple[str, DataFrame]],
    *,
    order_by: str,
    numeric_columns: Sequence[str] = (),
    title_hints: Sequence[str] = (),
) -> tuple[str, Extract]:
    """The first candidate table with a matched title row, else the first with rows."""
    fallback: tuple[str, Extract] | None = None
    for name, frame in candidates:
        try:
            extract = parse_table(
                frame, order_by=order_by, numeric_columns=numeric_columns, title_hints=title_hints
            ).require_rows()
        except ExtractError:
            continue
        if extract.titles.first()["matched"]:
            return name, extract
        fallback = fallback or (name, extract)
    if fallback is None:
        raise EmptyInputError()
    return fallback
