"""Exact top-k inner products, pruned by multi-resolution segment statistics.

A vector is cut into equal segments. From the mean and the deviation of each segment follows an
upper bound of an inner product,

    q . x  <=  sum over segments of  len * mean(q) * mean(x) + dev(q) * dev(x),

where ``dev`` is the Euclidean length of the segment minus its mean (the lower bound of the
distance, stated for inner products). A block of candidates is met with a block of queries
coarse to fine: with few segments, then with more; the exact integer products are computed only
for the pairs that no bound has excluded. All statistics of a block are two small matrices, so a
bound is one matrix product.

Distribution: the number of groups of candidates follows from a count, rows are dealt to them by
hash, and both sides are packed into blocks of bounded size inside map tasks. Each block of queries
is sent to every group, and each meeting returns at most ``k`` rows a query. A block of queries takes
a first threshold along, the k-th best score among ``SAMPLE`` rows chosen by hash, so pairs are
excluded from the first block on. The work is |queries| x |rows| by definition of the exact search.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors
of different lengths never meet; equal scores go to the smaller id; rows with a null id take no
part; of query rows with the same id the first by vector counts; repeated candidate rows each
count; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a packed block of queries and of candidates.
QUERY_BLOCK, ROW_BLOCK = 512, 4_096
#: Segments of the two levels, coarse first.
LEVELS = (4, 16)
#: Groups of candidate rows that a block of queries is sent to: this many at least, and so many
#: that none holds much more than ``GROUP_ROWS`` rows.
ROW_GROUPS, GROUP_ROWS = 32, 65_536
#: Rows whose scores give each query its first threshold.
SAMPLE = 1_024
#: Part of a block's pairs up to which the fine bounds are computed pair by pair.
FEW = 0.1
#: Relative slack of the floating-point bounds; exact scores are integers.
SLACK = 1e-9

_PACKED = "dim int, grp int, n int, ids binary, data binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` per component; null if a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & (F.size(vector) > 0), F.transform(doubles, lambda x: F.floor(x * scale).cast("bigint")))


def _pack(rows: int):
    """Packs (grp, id, v) rows of a task into blocks of at most ``rows`` rows of one group and dimension."""

    def flush(dim: int, grp: int, ids: list, data: list) -> pa.RecordBatch:
        got = [[dim], [grp], [len(ids)], [np.array(ids, np.int64).tobytes()], [np.stack(data).tobytes()]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(got, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
            names=["dim", "grp", "n", "ids", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            column = batch.column("v")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            groups = batch.column("grp").to_pylist()
            for i, ident in enumerate(batch.column("id").to_pylist()):
                vector = flat[offsets[i] : offsets[i + 1]]
                key = len(vector), groups[i]
                ids, data = open_blocks.setdefault(key, ([], []))
                ids.append(ident)
                data.append(vector)
                if len(ids) == rows:
                    yield flush(*key, ids, data)
                    del open_blocks[key]
        for key, (ids, data) in open_blocks.items():
            yield flush(*key, ids, data)

    return run


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of (mean part, deviation part) whose products bound inner products from above."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    sizes = np.diff(np.append(cuts, x.shape[1]))
    sums = np.add.reduceat(x, cuts, axis=1)
    means = sums / np.sqrt(sizes)
    rest = np.maximum(np.add.reduceat(x * x, cuts, axis=1) - means * means, 0.0)
    return np.hstack([means, np.sqrt(rest)])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of aligned integer rows."""
    return np.einsum("ij,ij->i", q, x)


def first_limits(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sampled rows but its own; no limit below k rows."""
    limit = np.full(len(q), -np.inf)
    for i in range(len(q)):
        scores = (x @ q[i])[xid != qid[i]]
        if len(scores) >= k:
            limit[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return limit


def best_of_block(
    qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, first: np.ndarray | None = None, tally: list | None = None
) -> Iterator[tuple]:
    """The ``k`` best (score, smaller id) candidates of each query within one block, exactly.

    Candidates below ``first``, a score that ``k`` rows of the table reach, may be left out. ``tally``
    takes the number of pairs that were computed exactly.
    """
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    limit = np.full(len(q), -np.inf) if first is None else first.copy()
    scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    features = [(segment_features(qf, s), segment_features(xf, s)) for s in LEVELS]
    slack = SLACK * (1 + np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(xf, axis=1)[None, :].max())
    for begin in range(0, len(x), 1024):
        cols = slice(begin, begin + 1024)
        alive = qid[:, None] != xid[None, cols]
        coarse_q, coarse_x = features[0]
        alive &= coarse_q @ coarse_x[cols].T + slack >= limit[:, None]
        rows, at = np.nonzero(alive)
        for fine_q, fine_x in features[1:]:
            if len(rows) > FEW * alive.size:
                fine = (fine_q @ fine_x[cols].T)[rows, at]
            else:
                fine = np.einsum("ij,ij->i", fine_q[rows], fine_x[begin + at])
            keep = fine + slack[rows, 0] >= limit[rows]
            rows, at = rows[keep], at[keep]
        if tally is not None:
            tally.append(len(rows))
        exact = np.empty(len(rows), np.int64)
        for part in range(0, len(rows), 65_536):
            sl = slice(part, part + 65_536)
            exact[sl] = _exact(q[rows[sl]], x[begin + at[sl]])
        for i in np.unique(rows):
            own = slice(*np.searchsorted(rows, [i, i + 1]))
            s = np.concatenate([scores[i], exact[own]])
            d = np.concatenate([ids[i], xid[begin + at[own]]])
            order = np.lexsort((d, -s))[:k]
            scores[i], ids[i] = s[order], d[order]
            if len(order) == k:
                limit[i] = max(limit[i], s[order[-1]])
    for i in range(len(q)):
        for s, d in zip(scores[i].tolist(), ids[i].tolist(), strict=True):
            yield int(qid[i]), d, s


def _block(row: dict, ids: str, data: str) -> tuple[np.ndarray, np.ndarray]:
    ident = np.frombuffer(row[ids], np.int64)
    return ident, np.frombuffer(row[data], np.int64).reshape(len(ident), -1)


def _limit(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, q = _block(row, "q_ids", "q_data")
                limit = np.full(len(qid), -np.inf) if row["ids"] is None else first_limits(qid, q, *_block(row, "ids", "data"), k)
                got = [[row["dim"]], [row["q_ids"]], [row["q_data"]], [limit.tobytes()]]
                types = pa.int32(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(got, types, strict=True)], names=["dim", "q_ids", "q_data", "q_limit"]
                )

    return run


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = np.frombuffer(row["q_limit"], np.float64)
                found = list(best_of_block(*_block(row, "q_ids", "q_data"), *_block(row, "ids", "data"), k, first))
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def row_groups(rows: int) -> int:
    """Groups of candidates for a table of ``rows`` rows."""
    return max(ROW_GROUPS, -(-rows // GROUP_ROWS))


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query but its own."""

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")

    groups = row_groups(rows.count())
    hashed = F.xxhash64("id", "v")
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("grp", F.lit(0))
    packed = asked.mapInArrow(_pack(QUERY_BLOCK), _PACKED).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    sample = clean(rows).orderBy(hashed, "id").limit(SAMPLE).withColumn("grp", F.lit(0))
    # at most SAMPLE rows in all, in one block for each dimension
    chosen = sample.coalesce(1).mapInArrow(_pack(SAMPLE), _PACKED).select("dim", "ids", "data")
    limits = packed.join(F.broadcast(chosen), "dim", "left")
    q = limits.mapInArrow(_limit(k), "dim int, q_ids binary, q_data binary, q_limit binary").withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    # dealt by hash, so that groups are even however the input is split and its ids are numbered
    spread = clean(rows).withColumn("grp", F.pmod(hashed, F.lit(groups)).cast("int")).repartition(groups, "grp")
    x = spread.mapInArrow(_pack(ROW_BLOCK), _PACKED)
    found = q.join(x, ["dim", "grp"]).mapInArrow(_meet(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
