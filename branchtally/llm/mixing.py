"""Mixing sources to target weights by Poisson replication.

A source with target share ``w`` of the mix and ``size`` characters is to be read at the rate
``w * total / size``. Each document draws its number of copies from the Poisson law with that
mean by inverting it: a uniform number from a hash of seed, id and text is looked up in the
source's table of cumulated probabilities. Copies are exploded and dealt to partitions by a
second hash that is also the order inside a partition, so the mix is shuffled globally.

The draw depends on the document alone: a lost task draws the same again. Only the size of each
source is gathered; sizes are combined before they are exchanged, and documents meet their
source's rate without being moved (a broadcast after a count, else a join that may split).

Defined cases: null texts have size 0 and are drawn at their source's rate like others; a null
source is a source of its own; a source without characters has rate 1; repeated rows draw the
same number of copies each; targets of sources that do not occur are left out of the whole;
empty tables give an empty result; all columns pass through, and input columns named like the
added ones (``copy``, ``mix_order``) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

SEED = 20_265
#: Exponent of the default weights: a source's share is its size to this power.
TEMPERATURE = 0.7
#: Characters of the mix as a multiple of the input's.
EPOCHS = 1.0


def hashed(seed: int, *cols: Column) -> Column:
    """52 bits of an MD5 over the columns' text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that the seed and the columns decide."""
    return hashed(seed, *cols).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, targets: dict[str, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, size, rate``: how often a document of the source is to be read on average.

    ``targets`` gives relative weights of named sources (others get none); without it the
    weights are the sizes to the power ``temperature``.
    """
    sizes = cut(docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size")))
    if targets is None:
        weight = F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(F.lit(0.0))
    else:
        named = F.create_map(*[x for s, w in targets.items() for x in (F.lit(s), F.lit(float(w)))]) if targets else None
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0)) if named is not None else F.lit(0.0)
        weight = F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))
    weighed = cut(sizes.withColumn("weight", weight))
    whole = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    share = F.try_divide("weight", "all_weight")
    rate = F.try_divide(share * F.col("all_size") * F.lit(float(epochs)), F.col("size"))
    return weighed.join(F.broadcast(whole)).select(
        "source", "size", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(1.0)).alias("rate")
    )


def poisson_table(rate: Column) -> Column:
    """P(N <= 0), P(N <= 1), ... of the Poisson law, far enough that the rest is below 2^-52.

    Terms are built from logarithms, so large rates do not underflow.
    """
    last = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    step = lambda acc, k: F.struct(
        (acc["log_p"] + F.log(rate) - F.log(k)).alias("log_p"),
        F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + F.exp(acc["log_p"] + F.log(rate) - F.log(k)))).alias("sums"),
    )
    begin = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("sums"))
    table = F.aggregate(F.sequence(F.lit(1), last), begin, step, lambda acc: acc["sums"])
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its draw, plus ``copy`` (from 0) and ``mix_order``."""
    docs = docs.drop("copy", "mix_order")
    tables = rates(docs, targets, epochs, temperature).select(F.col("source").alias("_source"), poisson_table(F.col("rate")).alias("_table"))
    drawn = docs.withColumn("_u", uniform(seed, F.col("doc_id"), F.col("text")))
    met = drawn.join(small_side(cut(tables)), F.col("source").eqNullSafe(F.col("_source")))
    copies = F.size(F.filter("_table", lambda p: p <= F.col("_u")))
    # sequence would count down from 0 to -1, so rows without copies go first
    repeated = met.withColumn("_n", copies).where("_n > 0").drop("_source", "_table", "_u")
    exploded = repeated.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    ordered = exploded.withColumn("mix_order", hashed(seed + 1, F.col("doc_id"), F.col("copy"), F.coalesce(F.length("text"), F.lit(0))))
    return ordered.repartition("mix_order").sortWithinPartitions("mix_order")


def weights_met(mixed: DataFrame) -> DataFrame:
    """``source, copies, chars``: what the mix holds, for a check against the targets."""
    return mixed.groupBy("source").agg(F.count("*").alias("copies"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
