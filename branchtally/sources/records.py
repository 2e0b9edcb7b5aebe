"""Records out of lines: quoted cells that hold line breaks, in files that stay splittable.

Whether a line begins inside a quoted cell depends on all lines before it. But each line's effect
is one of four: what is open stays open and what is closed closed, both turn around, or the line
leaves the quote open, or closed, whatever was before. Such effects compose, so a file split gives one
effect for all its lines, a prefix over the splits of a file says how each split begins, and then
every split says for itself which lines continue the record before. Records may cross splits.

Only files with a line that leaves a quote open are treated at all; others cost one look at the
lines with quotes. What is sorted holds no text (place, two flags and a length for each line of
these files); then the lines of records that span several are joined, in order, with line feeds.

A quote opens a cell only where a cell begins, so quotes inside plain cells mean nothing. A quote that is
never closed joins nothing: its line stands alone, and so do the lines after it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExtractError
from ..operators.joins import fits_broadcast
from ..session import ensure_checkpoint_dir

#: Bytes that a record of several lines may hold; a quote that closes later than that is an error.
RECORD_BYTES = 16 << 20

_KEYS = ("src", "blk", "row")


def quote_effects(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a quote is open after the line if none was open before it, and if one was."""
    d = re.escape(delimiter)
    rest = f"[^{d}]*+" if len(delimiter) == 1 else f"(?:(?!{d}).)*+"
    inside = '[^"]*+(?:""[^"]*+)*+'
    cells = f'(?:(?:"{inside}"{rest}|(?!"){rest}){d})*+'
    opens = f'(?s)^{cells}"{inside}$'
    stays = f'(?s)^{inside}(?:$|"{rest}{d}{cells}"{inside}$)'
    quoted = F.contains(line, F.lit('"'))
    return F.when(quoted, F.rlike(line, F.lit(opens))).otherwise(F.lit(False)), F.when(quoted, F.rlike(line, F.lit(stays))).otherwise(F.lit(True))


def opens_quote(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside of quotes leaves one open."""
    return quote_effects(line, delimiter)[0]


def whole_records(lines: DataFrame, delimiter: str, files: DataFrame) -> DataFrame:
    """``src, blk, row, line, span`` of the ``files`` (``src``): one row for each record, stored.

    ``blk`` and ``row`` are the first line's, ``span`` is how many lines the record has.
    """
    side = F.broadcast(files) if fits_broadcast(files) else files
    mine = lines.join(side, "src", "left_semi")
    members = stored(_members(mine, delimiter))
    longest = members.groupBy("src", "hblk", "hrow").agg(F.sum("size").alias("size")).agg(F.max_by(F.struct("src", "size"), "size").alias("r")).first()["r"]
    if longest is not None and longest["size"] > RECORD_BYTES:
        raise ExtractError(f"a quoted cell in {longest['src']} runs over {longest['size']} bytes; at most {RECORD_BYTES} are read as one record")
    places = members.drop("size")
    known = F.broadcast(places) if fits_broadcast(places) else places
    alone = mine.join(known, list(_KEYS), "left_anti").select(*_KEYS, "line", F.lit(1).alias("span"))
    part = F.struct("blk", "row", "line")
    found = mine.join(known, list(_KEYS)).groupBy("src", "hblk", "hrow").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    together = found.select(
        "src", F.col("hblk").alias("blk"), F.col("hrow").alias("row"),
        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"), F.size("parts").alias("span"),
    )
    records = stored(alone.unionByName(together))
    joined = records.where("span > 1").agg(F.sum("span")).first()[0] or 0
    if joined != members.count():
        raise ExtractError("lines of quoted cells were not met again: the files changed while they were read")
    return records


def _members(lines: DataFrame, delimiter: str) -> DataFrame:
    """``src, blk, row, size, hblk, hrow`` of the lines of records with several lines; h: the first line's."""
    opens, stays = quote_effects(F.col("line"), delimiter)
    size = F.octet_length("line") + 1
    narrow = lines.select(*_KEYS, size.alias("size"), opens.cast("int").alias("o"), stays.cast("int").alias("i"))

    # within a split: the state after each line, relative to how the split begins until a line fixes it
    here = Window.partitionBy("src", "blk").orderBy("row")
    run = Window.partitionBy("src", "blk", "run").orderBy("row")
    runs = narrow.withColumn("run", F.count_if(F.col("o") == F.col("i")).over(here))
    turned = F.sum(F.when((F.col("o") == 1) & (F.col("i") == 0), 1).otherwise(0)).over(run)
    fixed = F.when(F.col("run") > 0, F.first("o").over(run)).otherwise(0)
    after = runs.withColumns({"fixed": F.col("run") > 0, "after": ((fixed + turned) % 2).cast("int")}).drop("run", "o", "i")
    lined = after.withColumns({"before": F.lag("after", 1, 0).over(here), "known": F.lag("fixed", 1, False).over(here)})
    lined = stored(lined)

    # one row a split: its effect, and its last line that begins a record, for either beginning
    heads = {s: F.max(F.when(_state("before", "known", F.lit(s)) == 0, F.col("row"))) for s in (0, 1)}
    splits = lined.groupBy("src", "blk").agg(
        F.max_by(F.struct("fixed", "after"), "row").alias("end"), heads[0].alias("head0"), heads[1].alias("head1")
    )
    in_file = Window.partitionBy("src").orderBy("blk")
    runs = splits.withColumn("run", F.count_if(F.col("end.fixed")).over(in_file))
    run = Window.partitionBy("src", "run").orderBy("blk")
    turned = F.sum(F.when(~F.col("end.fixed"), F.col("end.after")).otherwise(0)).over(run)
    fixed = F.when(F.col("run") > 0, F.first("end.after").over(run)).otherwise(0)
    ends = runs.withColumn("closing", ((fixed + turned) % 2).cast("int"))
    begun = ends.withColumn("start", F.lag("closing", 1, 0).over(in_file))
    head = F.when(F.col("start") == 1, F.col("head1")).otherwise(F.col("head0"))
    headed = begun.withColumn("last_head", F.when(head.isNotNull(), F.struct(F.col("blk").alias("hblk"), head.alias("hrow"))))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("src").orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    never = F.when(F.last("closing").over(whole) == 1, F.last("last_head", ignorenulls=True).over(whole))
    facts = headed.select(
        "src", "blk", "start", F.last("last_head", ignorenulls=True).over(earlier).alias("carried"), never.alias("unclosed")
    )

    placed = lined.join(F.broadcast(facts) if fits_broadcast(splits) else facts, ["src", "blk"])
    states = placed.withColumns({"b": _state("before", "known", F.col("start")), "a": _state("after", "fixed", F.col("start"))})
    mine = F.last(F.when(F.col("b") == 0, F.struct(F.col("blk").alias("hblk"), F.col("row").alias("hrow"))), ignorenulls=True).over(here)
    named = states.withColumn("head", F.coalesce(mine, "carried"))
    several = ((F.col("b") == 1) | (F.col("a") == 1)) & ~F.col("head").eqNullSafe(F.col("unclosed"))
    return named.where(several).select(*_KEYS, "size", "head.hblk", "head.hrow")


def _state(relative: str, known: str, start: Column) -> Column:
    """A state that is absolute where it is ``known``, else relative to how the split begins."""
    return F.when(F.col(known), F.col(relative)).otherwise((F.col(relative) + start) % 2)


def stored(df: DataFrame, kind: str = "records") -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that places in it hold from then on."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
