"""Centroid clustering, fill-in-middle and SentencePiece against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException

from branchtally.llm import centroids, infill, pieces
from branchtally.llm.catalog import QUERIES

from .conftest import SF_DIR

# ---------------------------------------------------------------- centroid clustering


def kmeans_brute(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[1]))
    cents = [v for _, v in first[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    total = {c: sum(d for _, x, d in found if x == c) for c in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, total[c], sum(total.values()), sha[c]) for i, c, d in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, cells int").repartition(3)


def cases():
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25] * 8) for i in range(150)]  # many copies
    rows += [(7, [0.5] * 8), (7, [-0.5] * 8), (None, [0.1] * 8), (None, None), (2000, None), (2001, []), (2002, [0.1] * 7)]
    rows += [(2003, [float("nan")] + [0.0] * 7), (2004, [float("inf")] + [0.0] * 7), (2005, [None] + [0.0] * 7), (2006, [1e5] + [0.0] * 7)]
    return rows


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_by_brute_force(spark, bits):
    rows = cases()
    got = centroids.kmeans(vectors(spark, rows), k=5, rounds=3, dims=8, scale=64, bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == kmeans_brute(rows, 5, 3, 8, 64)


def test_clusters_of_few_and_no_vectors(spark):
    few = [(3, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None)]
    got = centroids.kmeans(vectors(spark, few), k=16, rounds=2, dims=2, scale=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == kmeans_brute(few, 16, 2, 2, 4)
    none = centroids.kmeans(vectors(spark, few).where("1 = 0"))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [x]) for i, x in enumerate([0.0, 2.0, 1.0, 1.0, 1.0, 4.0, 3.0])]
    got = centroids.kmeans(vectors(spark, rows), k=2, rounds=0, dims=1, scale=1).collect()
    assert sorted((tuple(r) for r in got), key=str) == kmeans_brute(rows, 2, 0, 1, 1)


def test_a_component_out_of_range_is_an_error(spark):
    with pytest.raises(PySparkException, match="leave 64 bits"):
        centroids.kmeans(vectors(spark, [(1, [3e30, 0.0]), (2, [0.0, 0.0])]), dims=2).collect()


def test_intervals_hold_and_decide_most_vectors(spark):
    kept = centroids.integer_vectors(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"), "vec_id", "embedding", 64, 64)
    stored, cells = centroids.approximations(kept, 64)
    cents = centroids.first_centroids(kept, 16)
    rows = stored.collect()
    x = np.stack([np.frombuffer(r["v"], np.int32) for r in rows]).astype(np.int64)
    packed = np.stack([np.frombuffer(r["cells"], np.uint8) for r in rows])
    assert packed.shape[1] == 64 * centroids.BITS // 8
    low, high = centroids.intervals(cells.unpack(packed), cells.tables(cents))
    exact = np.stack([centroids.squared(x, c) for c in cents], axis=1) - (x * x).sum(axis=1)[:, None]
    assert (low <= exact).all() and (exact <= high).all()
    found, fetched = centroids.nearest(packed, lambda at: x[at], cents, cells, cells.tables(cents))
    assert (found == exact.argmin(axis=1)).all() and fetched < 0.2 * len(x)
    by_id = dict(zip((r["id"] for r in rows), found.tolist(), strict=True))
    assigned = centroids.assign(stored, cents, cells)
    assert {r["id"]: r["cluster"] for r in assigned.collect()} == by_id
    scans = [line for line in stored.select("at", "id", "cells")._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in line]
    assert scans and all("v:binary" not in line for line in scans)


# ---------------------------------------------------------------- fill in the middle


def infill_brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def test_infill_by_brute_force(spark, documents, odd_docs):
    marks = [(5000 + i, t) for i, t in enumerate(["<P>", "a <S> b", "x <M>", "< P>", "a <", "P> b <", "\t", "é 日本 x \U0001f600"] * 8)]
    rows = documents.select("doc_id", "text").unionAll(odd_docs.select("doc_id", "text")).unionAll(spark.createDataFrame(marks, "doc_id bigint, text string"))
    got = sorted((tuple(r) for r in infill.digests(rows).collect()), key=str)
    assert got == sorted((infill_brute(*r) for r in rows.collect()), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_infill_outputs_restore_exactly(spark, documents):
    rows = documents.selectExpr("cast(doc_id as string) as doc_id", "text", "'x' as form")  # ids of another type
    out = infill.outputs(rows, rate=100)
    assert out.where("form <> 'plain'").count() > 100 and dict(out.dtypes)["doc_id"] == "string"
    assert out.where("form = 'spm' and not startswith(output, '<S>') or form = 'psm' and not startswith(output, '<P>')").count() == 0
    back = {r["doc_id"]: r["text"] for r in infill.originals(out).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert out.selectExpr("doc_id", "cast(null as string) as output", "form").transform(infill.originals).where("text is not null").count() == 0


def test_rotations_are_three_reversals(monkeypatch):
    monkeypatch.setattr(infill, "_BLOCK", 3)
    rnd = random.Random(1)
    for _ in range(500):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(40)))
        begin, cut, end = sorted(rnd.choices(range(len(data) + 1), k=3))
        buffer = bytearray(data)
        back = infill.rotate(buffer, begin, cut, end)
        assert bytes(buffer) == data[:begin] + data[cut:end] + data[begin:cut] + data[end:]
        infill.rotate(buffer, begin, back, end)
        assert bytes(buffer) == data


def test_token_ends_do_not_depend_on_slices(monkeypatch):
    text = ("ab c  \n d\t" * 30 + "  ").encode()
    whole = infill.token_ends(text).tolist()
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(infill, "_SLICE", size)
        assert infill.token_ends(text).tolist() == whole


# ---------------------------------------------------------------- SentencePiece


def piece_digest(sp, text):
    ids = sp.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))


@pytest.mark.parametrize(("block", "part"), [(8_000_000, 1 << 24), (20_000, 50_000), (1, 1 << 24)])
def test_pieces_match_the_library(spark, pairs, monkeypatch, block, part):
    """In one block and part, in many, and with a block for each text."""
    monkeypatch.setattr(pieces, "BLOCK", block)
    monkeypatch.setattr(pieces, "PART_BYTES", part)
    rows, df = pairs
    rows, df = (rows, df) if block > 1 else (rows[:150], spark.createDataFrame(rows[:150], "doc_id bigint, text string"))
    sp = pieces.processor(None)
    got = sorted(tuple(r) for r in pieces.digests(df.selectExpr("doc_id", "text", "1 as block", "2 as part")).collect())
    assert got == sorted((i, *piece_digest(sp, t)) for i, t in rows)


def test_pieces_encode_whole_where_words_are_not_apart(spark, pairs, monkeypatch):
    monkeypatch.setattr(pieces, "splits", lambda path: False)
    sp = pieces.processor(None)
    assert sorted(tuple(r) for r in pieces.digests(pairs[1]).collect()) == sorted((i, *piece_digest(sp, t)) for i, t in pairs[0])


def test_pieces_decode(spark, odd_docs):
    back = pieces.decode(pieces.encode(odd_docs))
    assert sorted(map(str, back.collect())) == sorted(map(str, odd_docs.selectExpr("doc_id", "coalesce(text, '') as text").collect()))
    assert pieces.decode(spark.createDataFrame([("a", None)], "doc_id string, ids array<int>")).collect()[0]["text"] == ""


def test_marked_words_are_segmented_apart(spark):
    sp, rnd = pieces.processor(None), random.Random(2)
    assert pieces.splits(None)
    for _ in range(3_000):
        text = "".join(rnd.choice(" ▁ab\n\t\x00é日\U0001f600<s>.9") for _ in range(rnd.randrange(12)))
        assert [i for ids in pieces.segment(sp, pieces.marked_words(text)) for i in ids] == sp.encode(text)


def test_packed_words_and_ids_come_back():
    words = ["▁", "▁▁", "▁a", "▁a\n\x00b", "▁" + "é" * 70_000, "▁😀"]
    assert pieces.unpack_words(pieces.pack_words(words)) == words and pieces.unpack_words(pieces.pack_words([])) == []
    ids = [[1], [2, 3], [], list(range(70_000))]
    sizes, flat = pieces.unpack_ids(pieces.pack_ids(ids))
    assert sizes.tolist() == [1, 2, 0, 70_000] and flat.tolist() == [i for part in ids for i in part]
    assert [len(x) for x in pieces.unpack_ids(pieces.pack_ids([]))] == [0, 0]


def test_each_distinct_word_is_segmented_once_and_unanswered_words_are_not_lost(documents, monkeypatch):
    texts, parts, segmented = [r["text"] or "" for r in documents.collect()], 4, []
    once = pieces.segment
    monkeypatch.setattr(pieces, "segment", lambda sp, words: segmented.extend(words) or once(sp, words))
    import pyarrow as pa

    column = pa.array([i for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([column, pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(pieces, "BLOCK", 200_000)
    asked = pa.Table.from_batches(pieces._questions(parts)(iter([batch])))
    answers = [pieces._answers(None)(asked.filter(pa.compute.equal(asked["part"], p))) for p in range(parts)]
    distinct = {w for t in texts for w in pieces.marked_words(t)}
    assert len(set(asked["block"].to_pylist())) > 2 and sorted(segmented) == sorted(distinct)

    sp, block = pieces.processor(None), next(pieces.blocks(iter([batch])))
    mine = {r["part"]: r["ids"] for t in answers for r in t.to_pylist() if r["block"] == block[0]}
    numbers, codes = pieces.coded(block[2])
    for given in (mine, {}, {0: mine[1], 1: mine[1]}):
        found = pieces.word_ids(sp, numbers, given, parts)
        assert [pieces.ids_at(c, *found).tolist() for c in codes] == sp.encode(block[2])


def test_new_queries_give_a_row_for_each_row(spark, documents):
    for name in ("op12_infill", "op13_pieces"):
        assert QUERIES[name](spark, SF_DIR).count() == documents.count()
