"""Choosing among several reference or master tables, and the id -> code mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnResolutionError
from ..functions import ORD, as_text, canonical_id, col, header_form, strip
from .columns import (
    ID_ALIASES,
    LOOKUP_KEY,
    MAIN_BRANCH,
    MAIN_CODE,
    MAIN_CODE_ALIASES,
    aliased_columns,
    reference_names,
    unresolved_reference,
)
from .joins import JoinPolicy, left_lookup
from .lookup import UNMAPPED, first_hit, row_order

Tables = Sequence[tuple[str, DataFrame]]

# How much a table name or a header says about being the right table.
_REFERENCE_NAME_POINTS = (("UKER", 100), ("UNIT KERJA", -10))
_REFERENCE_KEY_POINTS = {
    "KODE_UNIT": 40, "KODE UNIT": 40, "KODE SUB KANCA": 30, "KANCA": 20, "KODE KANCA": 10,
}
_MASTER_NAME_POINTS = ((("MASTER", "STATIS"), 100), (("DATA",), 50), (("COVER", "SUMMARY"), -20))
_ID_POINTS = {
    "ID": 40, "ID PRODUCT": 38, "ID_PRODUCT": 38, "ID USER": 35,
    "USER ID": 30, "USERID": 25, "ID QLOLA": 20, "CIF": 5,
}
_CODE_POINTS = {"MAIN_CODE": 40, "MAIN CODE": 35, "KODE INDUK": 30}
OVERLAP_WEIGHT = 10_000
# Candidates that share one whole number, a bit for each.
_MASK_BITS = 62


def pick_reference(tables: Tables, key: str = LOOKUP_KEY) -> tuple[str, DataFrame]:
    """The best reference table by its name and key header. Names only; reads no data."""
    wanted = {header_form(key), MAIN_CODE, MAIN_BRANCH}
    best: tuple[int, str, DataFrame] | None = None
    for name, frame in tables:
        found = reference_names(frame.columns, key)
        if set(found) != wanted:
            continue
        points = sum(p for word, p in _REFERENCE_NAME_POINTS if word in name.upper())
        points += _REFERENCE_KEY_POINTS.get(header_form(found[header_form(key)]), 0)
        if best is None or points > best[0]:
            best = (points, name, frame)
    if best is None:
        raise ColumnResolutionError(
            unresolved_reference({name: frame.columns for name, frame in tables}, key)
        )
    return best[1], best[2]


@dataclass(frozen=True)
class MappingCandidate:
    """One (table, id column, code column) that could be the master mapping."""

    table: str
    frame: DataFrame
    id_column: str
    code_column: str

    @property
    def preference(self) -> int:
        """The points of the table's name and of both headers, from the tables of fixed values."""
        name = self.table.upper()
        named = sum(p for words, p in _MASTER_NAME_POINTS if any(word in name for word in words))
        headers = (_ID_POINTS, self.id_column), (_CODE_POINTS, self.code_column)
        return named + sum(points.get(header_form(header), 0) for points, header in headers)

    @property
    def label(self) -> str:
        return f"{self.table}/{self.id_column}/{self.code_column}"


def mapping_candidates(tables: Tables) -> list[MappingCandidate]:
    found = [
        MappingCandidate(name, frame, i, c)
        for name, frame in tables
        for i in aliased_columns(frame.columns, ID_ALIASES)
        for c in aliased_columns(frame.columns, MAIN_CODE_ALIASES)
    ]
    if not found:
        looked_at = "\n".join(f"  {name}: {frame.columns}" for name, frame in tables)
        raise ColumnResolutionError(
            f"no master table has an id and a {MAIN_CODE} column.\nTables looked at:\n{looked_at}\n"
            f"Accepted headers:\n  ID: {list(ID_ALIASES)}\n  {MAIN_CODE}: {list(MAIN_CODE_ALIASES)}"
        )
    return found


def _usable(ids):
    return ids.isNotNull() & (ids != "") & (F.lower(ids) != "nan")


def id_mapping(candidate: MappingCandidate, order_by: str | None = None) -> DataFrame:
    """``ID, MAIN_CODE``: canonical ids, trimmed codes, first hit per id."""
    frame = candidate.frame
    pairs = frame.select(
        canonical_id(as_text(frame, candidate.id_column)).alias("ID"),
        strip(as_text(frame, candidate.code_column)).alias(MAIN_CODE),
        row_order(frame, order_by).alias(ORD),
    )
    return first_hit(pairs.where(_usable(F.col("ID"))), ["ID"], [MAIN_CODE])


def candidate_overlap(
    candidates: Sequence[MappingCandidate],
    probe: DataFrame,
    probe_id: str = "ID",
) -> DataFrame:
    """``candidate, overlap``: how many distinct probe ids each candidate knows.

    Each table is read once, whatever number of its columns are candidates. Master and probe
    rows meet in one aggregate by id, which keeps one bit for each candidate and one for the
    probe, so an id is one row for each task and nothing is joined; a second aggregate counts bits.
    """
    by_table: dict[int, list[tuple[int, MappingCandidate]]] = {}
    for n, c in enumerate(candidates):
        by_table.setdefault(id(c.frame), []).append((n, c))
    words = range(len(candidates) // _MASK_BITS + 1)

    def masks(ns: Sequence[int], probed: bool = False) -> list[Column]:
        bits = [sum(1 << n % _MASK_BITS for n in ns if n // _MASK_BITS == w) for w in words]
        return [F.lit(b).cast("long").alias(f"w{w}") for w, b in enumerate(bits)] + [F.lit(int(probed)).alias("probed")]

    ids = canonical_id(as_text(probe, probe_id))
    stacked = [probe.select(ids.alias("id"), *masks((), True))]
    for group in by_table.values():
        frame = group[0][1].frame
        by_id: dict[str, list[int]] = {}
        for n, c in group:
            by_id.setdefault(c.id_column, []).append(n)
        options = [
            F.struct(canonical_id(as_text(frame, name)).alias("id"), *masks(ns))
            for name, ns in by_id.items()
        ]
        stacked.append(frame.select(F.inline(F.array(*options))))
    known = reduce(DataFrame.unionAll, stacked).where(_usable(F.col("id")))
    by_mask = known.groupBy("id").agg(
        *[F.bit_or(f"w{w}").alias(f"w{w}") for w in words], F.max("probed").alias("probed")
    )
    holds = [
        F.count_if(F.col(f"w{n // _MASK_BITS}").bitwiseAND(F.lit(1 << n % _MASK_BITS)) != 0)
        for n in range(len(candidates))
    ]
    counted = by_mask.where("probed = 1").agg(F.array(*holds).alias("counts"))
    return counted.select(F.posexplode("counts").alias("candidate", "overlap")).where("overlap > 0")


def best_mapping(
    tables: Tables, probe: DataFrame | None = None, probe_id: str = "ID", order_by: str | None = None
) -> tuple[MappingCandidate, DataFrame]:
    """The candidate that knows most probe ids; names and headers break ties.

    A single candidate needs no counting job.
    """
    candidates = mapping_candidates(tables)
    overlap: dict[int, int] = {}
    if probe is not None and len(candidates) > 1:
        rows = candidate_overlap(candidates, probe, probe_id).collect()
        overlap = {r["candidate"]: r["overlap"] for r in rows}
    scores = [overlap.get(n, 0) * OVERLAP_WEIGHT + c.preference for n, c in enumerate(candidates)]
    winner = candidates[scores.index(max(scores))]
    return winner, id_mapping(winner, order_by)


def lookup_id(
    per_id: DataFrame, mapping: DataFrame, policy: JoinPolicy = JoinPolicy()
) -> DataFrame:
    """Each canonical id with its master code; a miss or a missing code is ``UNMAPPED``."""
    joined = left_lookup(per_id, mapping, "ID", policy)
    return joined.withColumn(MAIN_CODE, F.coalesce(col(MAIN_CODE), F.lit(UNMAPPED)))
