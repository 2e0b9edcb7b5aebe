"""Operators over whole tables: groups, top-k and shards."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchtally.llm import ngram_join, sharding, topk

from . import brute


def group_rows(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df, **kw).collect()}


def test_groups_of_documents(pairs):
    want, df = pairs
    assert group_rows(df) == brute.jaccard_groups(want)
    assert group_rows(df, k=5, num=80) == brute.jaccard_groups(want, 5, 80)


def edited(rng, base, edits, words):
    text = list(base)
    for _ in range(edits):
        at = int(rng.integers(len(text)))
        if rng.random() < 0.5:
            text[at] = str(rng.choice(words))
        elif rng.random() < 0.5 and len(text) > 4:
            del text[at]
        else:
            text.insert(at, str(rng.choice(words)))
    return " ".join(text)


def test_groups_of_edited_texts(spark):
    rng, rows = np.random.default_rng(5), []
    words = [f"w{i}" for i in range(3000)]
    for size in (5, 8, 12, 20, 33, 60, 120, 300):
        for _ in range(5):
            base = rng.choice(words, size)
            rows += [edited(rng, base, int(rng.integers(0, max(2, size // 25))), words) for _ in range(8)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id bigint, text string").repartition(4)
    assert group_rows(df) == brute.jaccard_groups([(int(i), t) for i, t in rows])


def test_a_large_group_is_split_and_still_whole(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 3000)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 100)
    rows = [(i, edited(rng, base, int(rng.integers(1, 6)), words)) for i in range(200)]
    assert group_rows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute.jaccard_groups(rows)


def test_signatures_of_the_same_sets_count_once_in_the_second_round(spark, monkeypatch):
    """Two long sets of different blocks share 500 signatures, a third shares others with the second."""
    rows, store = [], ngram_join.store

    def counted(df):
        out = store(df)
        if {"sig", "known"} <= set(df.columns):
            rows.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "store", counted)
    first = spark.createDataFrame([(1, 1, 0, True), (1, 2, 1, True), (1, 3, 2, True)], "root long, key long, block long, own boolean")
    pairs = [(s, k) for s in range(500) for k in (1, 2)] + [(s, k) for s in range(500, 900) for k in (2, 3)] * 2 + [(900, 3)]
    met = spark.createDataFrame([(s, k, 1) for s, k in pairs], "sig long, key long, first long")
    members = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "key long, n long")
    placed = ngram_join._second_round(first, spark.createDataFrame([], "node long, root long"), met, members, 80, 100).collect()
    # of each pair one asks the other's block, which stores the other
    at = {k: {r["block"] for r in placed if (r["key"], r["role"]) == k} for k in {(r["key"], r["role"]) for r in placed}}
    assert len(placed) == 4 and at[1, 0] == at[2, 1] != at[2, 0] == at[3, 1]
    assert max(rows) == 4


@pytest.mark.parametrize(("num", "parts"), [(85, True), (80, False), (70, False), (95, True)])
def test_signatures_lose_no_pair(num, parts):
    rng = np.random.default_rng(7)
    levels = rng.integers(0, 40, 1 << ngram_join.BUCKET_BITS).astype(np.uint8)
    kind = ngram_join.Signatures(num, 100, levels)
    assert kind.by_parts == parts
    for n in (1, 3, 6, 7, 8, 13, 20, 50, 140, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            room = int((100 - num) / 100 * len(a))
            drop = int(rng.integers(0, room + 1))
            add = int(rng.integers(0, room + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared) and len(b):
                assert np.intersect1d(kind.of(a), kind.of(b)).size


@pytest.mark.parametrize("num", [80, 85])
def test_sets_that_share_some_rare_shingles_do_not_meet(num):
    """Of 400 shingles 12 are shared and rarer than all others: far from a link, so hardly a signature is shared."""
    rng = np.random.default_rng(12)
    levels = np.full(1 << ngram_join.BUCKET_BITS, 34, np.uint8)
    levels[0] = 70  # some shingle is in most sets
    rare = rng.integers(0, 1 << 63, 12).astype(np.uint64) * np.uint64(2)
    levels[ngram_join.bucket(rare)] = 30
    kind = ngram_join.Signatures(num, 100, levels)
    held = [kind.of(np.unique(np.concatenate([rare, rng.integers(0, 1 << 63, 388).astype(np.uint64) * np.uint64(2)]))) for _ in range(40)]
    meet = sum(bool(np.intersect1d(a, b).size) for i, a in enumerate(held) for b in held[:i])
    assert meet <= 8  # of 780 pairs


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (95, 100), (77, 100), (1, 1), (1, 2)])
def test_linked_sizes_have_a_class_in_common(num, den):
    sizes = ngram_join.Sizes(num, den)
    for a in [*range(1, 300), *range(300, 30_000, 997)]:
        largest = a * den // num
        for b in {a, (a + largest) // 2, largest}:
            both = dict(sizes.meets(a)).keys() & dict(sizes.meets(b)).keys()
            assert both
            for cls in both:
                may = sizes.differ(a + b)
                assert may <= dict(sizes.meets(a))[cls] < sizes.parts(cls) and may <= dict(sizes.meets(b))[cls] < sizes.parts(cls)


def test_only_wanted_texts_are_shuffled(spark, monkeypatch):
    """Where places are too many for a broadcast, texts that nobody wants do not move; the groups are the same."""
    rng, kept, among = np.random.default_rng(15), [], getattr(ngram_join, "texts_among", None)

    def counted(read, wanted):
        out = among(read, wanted)
        kept.append((out.count(), out.join(wanted, out["th"] == wanted["w_th"], "left_semi").count(), wanted.count()))
        return out

    monkeypatch.setattr(ngram_join, "texts_among", counted)
    monkeypatch.setattr(ngram_join, "small_side", lambda df: df)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 100)]
    texts = [" ".join([*base[:-1], f"v{i}"]) for i in range(12)] + [" ".join(f"u{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(400)]
    got = group_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert [got[i][1] for i in range(412)] == [0] * 12 + list(range(12, 412))
    assert kept and all(k < 30 and there == wanted == 12 for k, there, wanted in kept)


def test_groups_in_any_blocks_and_parts(spark, documents, monkeypatch):
    """Small blocks, many parts of the signatures and many flushes change nothing."""
    want = brute.jaccard_groups([tuple(r) for r in documents.select("doc_id", "text").collect()], 5, 80)
    for block, part, combine in ((2_000, 20_000, 5_000), (500, 1 << 24, 500)):
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(ngram_join, "PART_BYTES", part)
        monkeypatch.setattr(ngram_join, "COMBINE", combine)
        assert group_rows(documents.repartition(5), k=5, num=80) == want


def test_first_thresholds_leave_fewer_pairs_and_the_same_rows():
    rng = np.random.default_rng(8)
    centre = rng.integers(-900, 900, (12, 32))
    x = (centre[rng.integers(0, 12, 4_000)] + rng.integers(-60, 60, (4_000, 32))).astype(np.int64)
    xid, q = np.arange(4_000), x[::200]
    qid = xid[::200]
    plain, sieved = [], []
    want = list(topk.best_of_block(qid, q, xid, x, 10, tally=plain))
    first = topk.first_limits(qid, q, xid[::4], x[::4], 10)
    got = list(topk.best_of_block(qid, q, xid, x, 10, first, sieved))
    assert got == want and sum(sieved) < sum(plain) / 2
    assert np.isinf(topk.first_limits(qid, q, xid[:10], x[:10], 10)[0])


def test_candidates_are_dealt_evenly(spark):
    assert topk.row_groups(20_000) == 32 and topk.row_groups(10**8) == 1_526
    df = spark.range(20_000).selectExpr("id * 32 as id", "array(id, 1L) as v")
    sizes = [r[0] for r in df.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(32))).count().select("count").collect()]
    assert len(sizes) == 32 and max(sizes) < 1.2 * 625


def test_packed_numbers_come_back():
    x = np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)
    for part in (x, x[:1], x[:0], np.sort(x)):
        assert (ngram_join.unpack_numbers(ngram_join.pack_numbers(part)) == part).all()


def test_components(spark):
    name = [int(x) for x in np.random.default_rng(11).integers(0, 1 << 62, 102)]
    back = {x: i for i, x in enumerate(name)}
    edges = [(name[i], name[j]) for i, j in [(i, i + 1) for i in range(0, 40) if i != 17] + [(100, 101), (5, 5)]]
    got = {back[r["node"]]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(0, 18)}) == len({got[i] for i in range(18, 41)}) == 1
    assert got[0] != got[18] and got[100] == got[101] != got[0]
    assert ngram_join.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_group_stays(odd_docs):
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("repeat me") == 1 and texts.count("one") == 1 and None in texts and "" in texts


def test_one_of_each_group_is_decided_by_id_and_text(spark):
    """An unrelated text under the id of a copy stays; near copies without ids go; clashing names pass."""
    base = [f"w{i}" for i in range(150)]
    near = lambda i: " ".join([*base[:i], f"x{i}", *base[i:]])
    rows = [
        (1, near(3)), (2, near(9)), (2, "another text that is like nothing else here at all"), (None, near(20)), (None, near(30)),
        (None, "quite alone without any id in this whole table"), (1, near(3)), (5, ""), (5, None), (6, "  "),
    ]
    names = ["doc_id", "text", "th", "root", "kept", "key", "n", "_gone", "_id", "count"]
    df = spark.createDataFrame([(*r, *["z"] * 8) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names[2:])).repartition(3)
    kept = ngram_join.keep_one(df)
    assert kept.columns == names
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[5], *rows[7:]], key=str)
    nameless = ngram_join.keep_one(df.where("doc_id is null"))
    assert nameless.count() == 2
    text_ids = df.selectExpr("'d' || doc_id as doc_id", "text")
    assert {(r[0], r[2]) for r in ngram_join.groups(text_ids).collect()} >= {("d1", "d1"), ("d2", "d1")}
    assert ngram_join.keep_one(text_ids).count() == kept.count()


def top(rows, k=10):
    want = []
    v = {i: np.floor(1024 * np.array(x, float)).astype(int) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x)}
    for q in v:
        if q % 100 == 0:
            best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=32), 1)]) for i in range(900)]  # rounded: ties
    rows += [(1000 + i, rows[i][1]) for i in range(50)]
    rows += [(2000, None), (2100, [None, 1.0]), (2200, [float("nan")] * 32), (2300, []), (2400, [1.0, 2.0]), (2500, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as score")
    got = topk.top_k(df.repartition(5), df.where("vec_id % 100 = 0"), "vec_id", "embedding")
    assert sorted(map(tuple, got.collect())) == top(rows)
    none = df.where("1 = 0")
    assert topk.top_k(none, none, "vec_id", "embedding").count() == 0


def test_segment_bounds_are_bounds():
    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(20, 30)), rng.normal(size=(50, 30))
    coarse, fine = (topk.segment_features(q, s) @ topk.segment_features(x, s).T for s in (4, 16))
    assert (coarse + 1e-9 >= q @ x.T).all() and (fine + 1e-9 >= q @ x.T).all() and fine.mean() < coarse.mean()


def test_shards_are_even_and_gapless(spark, documents, odd_docs):
    import zlib

    rows = [tuple(r) for r in documents.select("doc_id", "text").unionAll(odd_docs.select("doc_id", "text")).collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sharding.shard_rows(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shard_rows(df.repartition(3)).collect()
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and {tuple(r) for r in got} == {tuple(r) for r in again}


def test_drawn_counts_follow_the_hypergeometric_law():
    rng = np.random.default_rng(10)
    draws = np.array([sharding.draw_hypergeometric(rng, 30, 50, 20) for _ in range(20_000)])
    assert abs(draws.mean() - 20 * 30 / 80) < 0.05
    assert abs(draws.var() - 20 * (3 / 8) * (5 / 8) * 60 / 79) < 0.15
    huge = sharding.draw_hypergeometric(rng, 10**12, 10**12, 10**6)
    assert abs(huge - 5 * 10**5) < 6 * 500
    matrix = sharding.communication_matrix([5, 0, 17, 3], 4, 1)
    assert matrix.sum(1).tolist() == [5, 0, 17, 3] and sorted(matrix.sum(0).tolist()) == [6, 6, 6, 7]


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    sharding.write_shards(documents.where("doc_id < 50"), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and sorted(r[0] for r in back.groupBy("shard").count().select("count").collect()) == [16, 17, 17]
    assert set(back.columns) == {*documents.columns, "shard", "slot"}


@pytest.mark.parametrize("seed", [1, 2])
def test_other_seeds_deal_otherwise(documents, seed):
    a = sharding.shard_rows(documents, seed=seed).where("shard = 0").select("doc_id").collect()
    b = sharding.shard_rows(documents, seed=seed + 2).where("shard = 0").select("doc_id").collect()
    assert {r[0] for r in a} != {r[0] for r in b}


@pytest.mark.parametrize("block", [300, 1_500_000])
def test_ngram_join_stores_neither_sets_nor_signatures(spark, monkeypatch, block):
    """Signatures and sets move once, to their part or block; rows that repeat id and text count once there."""
    rng, stored, store = np.random.default_rng(5), [], ngram_join.store
    monkeypatch.setattr(ngram_join, "store", lambda df: stored.extend(t for _, t in df.dtypes) or store(df))
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 100)]
    texts = [" ".join([*base[:-1], f"v{i}"]) for i in range(12)]  # all near copies of each other
    docs = [(i, t) for i, t in enumerate(texts)] * 2 + [(50, "apart from all others"), (51, None)]
    got = ngram_join.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted([(i, 0) for i in range(12)] * 2 + [(50, 50), (51, 51)])
    assert stored and "binary" not in stored
