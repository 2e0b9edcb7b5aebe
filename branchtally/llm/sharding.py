"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in *cells* named by a hash of their content, so a cell means the same rows in every
run and on every cluster. How many rows each cell sends to each shard is drawn exactly from the
multivariate hypergeometric law with the shards' capacities; within a cell a random order
decides which rows those are; within a shard a second random order decides the slots. Together
every assignment of rows to slots is equally likely, and shard sizes differ by one at most.

Only (doc_id, size, checksum) rows are exchanged; texts stay where they are unless
``write_shards`` stores them.

Defined cases: a null text has size 1 and the checksum of an empty text; null ids are dealt like
others; repeated rows are dealt one by one; an empty table gives an empty result; further
columns are carried by ``shard_rows`` under their own names, the added ones start with an
underscore and are renamed at the end, so clashing input columns are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that a cell, or a bucket of slots, holds on average.
CELL_ROWS = 20_000
#: Bounds on the number of cells; the matrix has at most this many rows on the driver.
LEAST_CELLS, MOST_CELLS = 64, 65_536
SEED = 20_261


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One exact draw for populations of any size, by inverting the law around its mode."""
    low, high = max(0, sample - bad), min(good, sample)
    if low >= high:
        return low
    total = good + bad
    sd = np.sqrt(max(1e-9, sample * (good / total) * (bad / total) * (total - sample) / max(1, total - 1)))
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    k = np.arange(max(low, int(mode - 40 * sd - 40)), min(high, int(mode + 40 * sd + 40)) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[1:]) - np.log(bad - sample + k[1:])
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log_p - log_p.max())
    return int(k[min(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"), len(k) - 1)])


def communication_matrix(cell_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each cell (first axis) to each shard; columns sum to the exact shard sizes."""
    rng = np.random.default_rng(seed)
    total = sum(cell_rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(cell_rows), shards), dtype=np.int64)
    for i, rows in enumerate(cell_rows):
        rest, pool = rows, sum(left)
        for s in range(shards):
            pool -= left[s]
            out[i, s] = got = draw_hypergeometric(rng, left[s], pool, rest)
            rest -= got
            left[s] -= got
    return out


def _random(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def assign(rows: DataFrame, identity: list[str], shards: int = 8, seed: int = SEED) -> DataFrame:
    """``rows`` plus ``_shard`` and ``_slot``; ``identity`` are the columns that tell rows apart."""
    spark = rows.sparkSession
    total = rows.count()
    cells = int(min(MOST_CELLS, max(LEAST_CELLS, -(-total // CELL_ROWS))))
    keys = [F.col(c) for c in identity]
    placed = rows.withColumn("_cell", F.pmod(_random(seed, *keys), F.lit(cells)).cast("int"))
    counts = dict(placed.groupBy("_cell").count().collect())  # at most MOST_CELLS rows
    matrix = communication_matrix([counts.get(c, 0) for c in range(cells)], shards, seed)
    sent = spark.createDataFrame(
        [(c, [int(v) for v in np.cumsum(matrix[c])]) for c in range(cells)], "_cell int, _upto array<bigint>"
    )
    local = Window.partitionBy("_cell").orderBy(_random(seed + 1, *keys), *keys)
    dealt = (
        placed.withColumn("_nth", F.row_number().over(local))
        .join(F.broadcast(sent), "_cell")  # at most MOST_CELLS rows of `shards` numbers
        .withColumn("_shard", F.size(F.filter("_upto", lambda upto: upto < F.col("_nth"))))
        .withColumn("_bucket", F.pmod(_random(seed + 2, *keys), F.lit(max(1, cells // shards))).cast("int"))
        .drop("_cell", "_nth", "_upto")
    )
    dealt = cut(dealt)
    sizes = dealt.groupBy("_shard", "_bucket").count()
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_shard", "_bucket").orderBy(_random(seed + 3, *keys), *keys)
    return (
        dealt.join(F.broadcast(offsets), ["_shard", "_bucket"])  # at most MOST_CELLS rows
        .withColumn("_slot", F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_bucket", "_offset")
    )


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        F.col("doc_id"),
        F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.octet_length("text") + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    return assign(light, ["doc_id", "_text"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED) -> None:
    """Stores the documents as Parquet folders ``shard=0`` and so on, with their slots.

    A shard is spread over many files by ranges of slots, so no task holds a whole shard.
    """
    keyed = docs.withColumn("_text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    placed = assign(keyed, ["doc_id", "_text"], shards, seed).drop("_text").drop("shard", "slot")
    named = placed.withColumnRenamed("_shard", "shard").withColumnRenamed("_slot", "slot")
    spread = named.repartition(F.col("shard"), F.floor(F.col("slot") / CELL_ROWS)).sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").parquet(path)
