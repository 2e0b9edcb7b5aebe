"""Centroid clustering of integer vectors through a vector-approximation file.

Every component is put into one of a few cells of its dimension; a vector's cells, packed to a few
bits each, are its approximation. For a set of centroids two small lookup tables hold what a cell
of a dimension adds at least and at most to the squared distance, so one sum of table rows gives
an interval for the distance of a vector to every centroid. The vector's own square is the same
for all centroids and left out: |x - c|^2 - |x|^2 sums c (c - 2x), whose interval is as wide as
the centroid's component times the cell, and not as wide as the distance times the cell. Where
the least upper end lies below all other lower ends the nearest centroid is known. Only where intervals overlap the full vector
is fetched, and compared with the centroids that its intervals leave.

The cells of a dimension are of equal width between two quantiles far out, over all vectors; the
outer cells end at the least and the greatest value. So a few far values do not widen the others,
and an interval is never wrong however the quantiles are approximated. Everything is an integer, so results do not
depend on the order of rows.

Distribution: vectors and approximations are stored once. A round is one map over them with the
tables in the closure; each task gives one row of sums a centroid, so there is no shuffle of
vectors and what reaches the driver is one row a centroid. The update rule asks for the sums of all vectors,
so a round passes over the stored vectors, but distances are computed for the overlapping ones
alone; ``assign`` (nearest centroids without sums) reads the approximations alone and fetches
the overlapping vectors by a join. Rounds depend on stored rows and on driver integers only, so
a lost executor costs its tasks and no more.

Defined cases: vectors that are null, have another number of components or hold null or
non-finite ones take no part; a component whose integer is beyond 2^27 ends the run with an error,
as squared distances would leave 64 bits; equal distances go to the smaller centroid number; rows with
equal ids each take part, and as first centroids they follow their components; null ids come last
there; with fewer vectors than centroids each vector is one; an empty centroid stays where it is;
repeated vectors each count; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, store

#: Bits of a cell; a dimension has at most 2^BITS cells.
BITS = 6
#: Share of values that may lie beyond the cells of equal width, on each side.
OUTER = 0.001
#: Components are integers below this, so that a squared distance fits a long.
MOST = 1 << 27
#: Vectors whose intervals are computed at once.
TOGETHER = 4_096
SEED = 1

_STORED = "id bigint, cells binary, v binary"


def integers(vector: Column, dims: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null unless there are ``dims`` finite ones."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists(doubles, lambda x: F.abs(x * scale) >= MOST)
    floors = F.transform(doubles, lambda x: F.floor(x * scale).cast("int"))
    refused = F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}: its squared distances leave 64 bits"))
    return F.when((F.size(vector) == dims) & ~bad, F.when(far, refused.cast("array<int>")).otherwise(floors))


# ---------------------------------------------------------------- approximations


@dataclass(frozen=True)
class Cells:
    """Cells by dimension: ``inner`` the first value of each cell but the first, and true outer ends."""

    inner: tuple[np.ndarray, ...]
    least: np.ndarray
    greatest: np.ndarray
    bits: int

    @classmethod
    def of(cls, ends: list[tuple[int, int, int, int]], bits: int) -> "Cells":
        """Cells of equal width between the two middle values of each dimension's ``ends``, and one beyond each."""
        cuts = [np.unique(np.floor(np.linspace(low, high + 1, (1 << bits) - 1)).astype(np.int64)) for _, low, high, _ in ends]
        inner = tuple(c[(c > least) & (c <= greatest)] for c, (least, _, _, greatest) in zip(cuts, ends, strict=True))
        return cls(inner, np.array([e[0] for e in ends], np.int64), np.array([e[3] for e in ends], np.int64), bits)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """The cells of the rows of ``x``, ``bits`` bits a dimension."""
        cells = np.stack([np.searchsorted(edges, x[:, d], side="right") for d, edges in enumerate(self.inner)], axis=1)
        spread = (cells[:, :, None] >> np.arange(self.bits - 1, -1, -1)) & 1
        return np.packbits(spread.reshape(len(x), -1).astype(np.uint8), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        dims = len(self.inner)
        spread = np.unpackbits(packed, axis=1)[:, : dims * self.bits].reshape(len(packed), dims, self.bits)
        return spread @ (1 << np.arange(self.bits - 1, -1, -1))

    def tables(self, centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By dimension (least, greatest) addition of each cell, a row a cell and a column a centroid."""
        out = []
        for d, edges in enumerate(self.inner):
            low = np.append(self.least[d], edges)[:, None]
            high = np.append(edges - 1, self.greatest[d])[:, None]
            c = centroids[None, :, d]
            one, other = c * (c - 2 * low), c * (c - 2 * high)  # linear in x, so its ends are at the cell's
            out.append((np.minimum(one, other), np.maximum(one, other)))
        return out


def intervals(cells: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) ends of each row's squared distance to each centroid, less the row's own square."""
    low = np.zeros((len(cells), tables[0][0].shape[1]), np.int64)
    high = np.zeros_like(low)
    for d, (near, far) in enumerate(tables):
        low += near[cells[:, d]]
        high += far[cells[:, d]]
    return low, high


def left_over(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which centroids the intervals leave to each row: those that can still be the nearest.

    A centroid goes if another one's upper end is below its lower end, or equal to it and the
    other has the smaller number.
    """
    best = high.argmin(axis=1)  # the smallest number of the least upper ends
    end = high[np.arange(len(high)), best][:, None]
    return (low < end) | ((low == end) & (np.arange(low.shape[1]) <= best[:, None]))


def nearest(packed: np.ndarray, vectors, centroids: np.ndarray, cells: Cells, tables: list) -> tuple[np.ndarray, int]:
    """(nearest centroid of each row, rows whose vectors were fetched).

    ``vectors(rows)`` gives the full vectors of the rows whose intervals overlap.
    """
    found, fetched = np.empty(len(packed), np.int32), 0
    for begin in range(0, len(packed), TOGETHER):
        part = slice(begin, begin + TOGETHER)
        left = left_over(*intervals(cells.unpack(packed[part]), tables))
        here = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            here[open_rows] = among(vectors(begin + open_rows), left[open_rows], centroids)
            fetched += len(open_rows)
        found[part] = here
    return found, fetched


def among(x: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each full vector among those that are left to it; ties to the smaller."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.zeros(len(x), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(left[:, c])
        d = squared(x[rows], centroids[c])
        better = d < best[rows]
        best[rows[better]], found[rows[better]] = d[better], c
    return found


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((x - centroid) ** 2).sum(axis=1)


# ---------------------------------------------------------------- Arrow functions


def _stack(column: pa.Array, kind) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    raw = b"".join(v.as_py() for v in column)
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def _fetcher(column: pa.Array):
    return lambda rows: _stack(column.take(pa.array(rows)), np.int32).astype(np.int64)


def _approximate(cells: Cells, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy().astype(np.int32).reshape(len(v), dims)
            columns = [batch.column("id"), pa.array([p.tobytes() for p in cells.pack(x)], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cells", "v"])

    return run


def _sums(centroids: np.ndarray, cells: Cells):
    """One row a task and centroid: how many vectors are nearest to it, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        fetched = 0
        for batch in batches:
            v = batch.column("v")
            cluster, n = nearest(_stack(batch.column("cells"), np.uint8), _fetcher(v), centroids, cells, tables)
            fetched += n
            counts += np.bincount(cluster, minlength=len(centroids))
            x = _stack(v, np.int32)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0, dtype=np.int64)
        rows = np.flatnonzero(counts)
        if len(rows):
            columns = [pa.array(rows), pa.array(counts[rows]), pa.array(sums[rows].tolist(), pa.list_(pa.int64())), pa.array([fetched] + [0] * (len(rows) - 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums", "fetched"])

    return run


def _final(centroids: np.ndarray, cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for batch in batches:
            cluster, _ = nearest(_stack(batch.column("cells"), np.uint8), _fetcher(batch.column("v")), centroids, cells, tables)
            distance = squared(_stack(batch.column("v"), np.int32).astype(np.int64), centroids[cluster])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def _decided(centroids: np.ndarray, cells: Cells):
    """From approximations alone: the cluster, or null and the centroids that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for batch in batches:
            left = left_over(*intervals(cells.unpack(_stack(batch.column("cells"), np.uint8)), tables))
            several = left.sum(axis=1) > 1
            masks = [np.packbits(m).tobytes() if s else None for m, s in zip(left, several, strict=True)]
            columns = [batch.column("at"), batch.column("id"), pa.array(left.argmax(axis=1).astype(np.int32), mask=several), pa.array(masks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "id", "cluster", "remaining"])

    return run


def _settled(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.unpackbits(_stack(batch.column("remaining"), np.uint8), axis=1)[:, : len(centroids)].astype(bool) if len(batch) else np.zeros((0, len(centroids)), bool)
            x = _stack(batch.column("v"), np.int32).astype(np.int64) if len(batch) else np.zeros((0, centroids.shape[1]), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(among(x, left, centroids).astype(np.int32))], names=["id", "cluster"])

    return run


# ---------------------------------------------------------------- Spark


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id, v`` of the vectors that take part, stored."""
    return store(rows.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector_col), dims, scale).alias("v")).where("v is not null"))


def approximations(kept: DataFrame, dims: int, bits: int = BITS) -> tuple[DataFrame, Cells | None]:
    """(``at, id, cells, v`` of the integer vectors, stored; their cells); no cells without vectors.

    ``at`` numbers the stored rows, so that rows with equal ids stay apart.
    """
    values = [F.col("v")[d] for d in range(dims)]
    ends = F.array(*[F.array(F.min(x), *[F.percentile_approx(x, q, round(4 / OUTER)) for q in (OUTER, 1 - OUTER)], F.max(x)) for x in values])
    found = kept.agg(F.count("*").alias("n"), ends.alias("ends")).first()
    if not found["n"]:
        return kept, None
    cells = Cells.of([tuple(e) for e in found["ends"]], bits)
    packed = kept.mapInArrow(_approximate(cells, dims), _STORED)
    return store(packed.select(F.monotonically_increasing_id().alias("at"), "id", "cells", "v")), cells


def first_centroids(kept: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose hashed ids are smallest; equal ids in the order of their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(order.alias("o"), "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)


def update(stored: DataFrame, centroids: np.ndarray, cells: Cells) -> tuple[np.ndarray, int]:
    """(the centroids after one round, vectors fetched because their intervals overlapped)."""
    parts = stored.select("cells", "v").mapInArrow(_sums(centroids, cells), "cluster bigint, n bigint, sums array<bigint>, fetched bigint")
    totals = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(centroids.shape[1])]
    moved, fetched = centroids.copy(), 0
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("fetched").alias("fetched"), *totals).collect():
        moved[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(centroids.shape[1])]
        fetched += row["fetched"]
    return moved, fetched


def assign(stored: DataFrame, centroids: np.ndarray, cells: Cells) -> DataFrame:
    """``id, cluster`` of each stored vector, from its approximation wherever that decides.

    The scan reads the approximations alone; the vectors that stay open are fetched by a join.
    """
    verdicts = store(stored.select("at", "id", "cells").mapInArrow(_decided(centroids, cells), "at bigint, id bigint, cluster int, remaining binary"))
    undecided = small_side(verdicts.where("cluster is null").select("at", "remaining"))
    fetched = stored.select("at", "id", "v").join(undecided, "at")
    settled = fetched.select("id", "remaining", "v").mapInArrow(_settled(centroids), "id bigint, cluster int")
    return verdicts.where("cluster is not null").select("id", "cluster").unionAll(settled)


def kmeans(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = BITS
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector."""
    spark = rows.sparkSession
    kept = integer_vectors(rows, id_col, vector_col, dims, scale)
    stored, cells = approximations(kept, dims, bits)
    if cells is None:
        return stored.selectExpr(
            f"id as `{id_col}`", "cast(null as int) as cluster", "cast(null as bigint) as distance", "cast(null as bigint) as cluster_inertia",
            "cast(null as bigint) as inertia", "cast(null as string) as centroid_sha256",
        )
    centroids = first_centroids(kept, k)
    for _ in range(rounds):
        centroids, _ = update(stored, centroids, cells)
    found = store(stored.select("id", "cells", "v").mapInArrow(_final(centroids, cells), "id bigint, cluster int, distance bigint"))
    by_cluster = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, by_cluster[c], sum(by_cluster.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in by_cluster]
    schema = pa.schema([("cluster", pa.int32()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])
    named = spark.createDataFrame(pa.table([pa.array(col, f.type) for col, f in zip(zip(*facts, strict=True), schema, strict=True)], schema=schema))
    return found.join(F.broadcast(named), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
