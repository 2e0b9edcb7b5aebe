"""What several operators share: tables, match spans, checked broadcasts, cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from branchtally.session import ensure_checkpoint_dir

#: Rows up to which a side is broadcast after it was counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored once in the shared checkpoint folder; lost executors lose nothing of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Unlike ``cut`` nothing of the plan before is kept, neither its constraints nor its estimates,
    so that rounds of joins on their own results stay as cheap as the first.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``most`` rows, else unchanged.

    ``df`` has narrow rows and cut lineage, so that counting it costs little. Without the
    hint Spark joins by shuffle; the rows that come out are the same.
    """
    return F.broadcast(df) if df.count() <= most else df


#: Items of an array that are folded at once; see ``running``.
FOLD = 256


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, though ``then`` may use it inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(items: Column, kind: str, step) -> Column:
    """What ``step`` emits over ``items``, as ``array<kind>``.

    ``step(at, item)`` gives the next ``at``, an int that begins at 0, and an array of what the
    item emits. An array grows by being copied, so the fold runs in blocks of ``FOLD`` items and
    joins the blocks at the end: the time stays near linear in the items of one long text.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        at, out = step(acc["at"], item)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def folded(every: Column) -> Column:
        def block(acc: Column, first: Column) -> Column:
            part = F.aggregate(F.slice(every, first, FOLD), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        firsts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(FOLD))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(firsts, begin, block, lambda acc: acc["out"]))

    return bound(items, folded)


def matches(text: Column, pattern: str | Column) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, end, hit>>``.

    Offsets count code points from 0, the end is exclusive. The gaps between matches come
    from ``split`` with the same pattern, so a running sum of lengths gives every offset.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.coalesce(end, start), F.array(found)

    # the last pair is the rest of the text without a match
    return F.filter(running(pairs, "struct<start:int,end:int,hit:string>", step), lambda m: m["hit"].isNotNull())


def matches_if(text: Column, sieve: Column, pattern: str) -> Column:
    """``matches`` where the cheap ``sieve`` holds, else no match."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(sieve, matches(text, pattern)).otherwise(none)


def disjoint(spans: Column, instead) -> Column:
    """Of spans (start, end, ...) sorted by start, the parts that no earlier span covers.

    They come out as (start, end, instead): ``instead(start, end, first)`` says what stands for a
    part, and ``first`` whether it begins a new stretch or continues one of overlapping spans.
    """

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = F.greatest(m["start"], at)
        part = F.struct(start.alias("start"), m["end"].alias("end"), instead(start, m["end"], m["start"] >= at).alias("instead"))
        none = F.array().cast("array<struct<start:int,end:int,instead:string>>")
        return F.greatest(at, m["end"]), F.when(m["end"] > at, F.array(part)).otherwise(none)

    return running(spans, "struct<start:int,end:int,instead:string>", step)


def spans_text(kind: str, found: Column) -> Column:
    """``kind:start:end`` of each match, as an array of strings."""
    return F.transform(found, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def cut_out(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted, disjoint ``spans`` (start, end, instead) replaced.

    A stretch of the text is cut for ``FOLD`` spans at once and searched for them alone, so a
    long text is not walked through from its begin for every span.
    """

    def folded(every: Column) -> Column:
        def block(acc: Column, first: Column) -> Column:
            own = F.slice(every, first, FOLD)
            until = F.element_at(own, -1)["end"]
            begin = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))

            def pieces(piece: Column) -> Column:
                def one(now: Column, s: Column) -> Column:
                    before = F.substring(piece, now["at"] - acc["at"] + 1, s["start"] - now["at"])
                    return F.struct(s["end"].alias("at"), F.concat(now["out"], F.array(before, s["instead"])).alias("out"))

                return F.array_join(F.aggregate(own, begin, one, lambda now: now["out"]), "")

            joined = bound(F.substring(text, acc["at"] + 1, until - acc["at"]), pieces)
            return F.struct(until.alias("at"), F.concat(acc["out"], F.array(joined)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
        return F.aggregate(F.sequence(F.lit(1), F.size(every), F.lit(FOLD)), start, block, rest)

    return bound(spans, lambda every: F.when(F.size(every) > 0, folded(every)).otherwise(text))
