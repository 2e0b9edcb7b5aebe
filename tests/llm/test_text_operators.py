"""Operators that judge each text: against plain Python, and on odd rows."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchtally.llm import bpe, common, licenses, mixing, pii, quality, secrets, textnp, toxicity

from . import brute


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_word_hashes_agree_with_words_and_ignore_slices(monkeypatch):
    text = ("the The  caté " * 50 + "x" * 700 + "\n the").encode().lower()
    at, hashes, _ = textnp.hash_words(text, textnp.NOT_SPACE)
    words = text.split()
    assert len(hashes) == len(words) and [text[a : a + len(w)] for a, w in zip(at, words, strict=True)] == words
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    monkeypatch.setattr(textnp, "SLICE", 64)
    assert (textnp.hash_words(text, textnp.NOT_SPACE)[1] == hashes).all()


def test_personal_data(pairs):
    want, df = pairs
    got = rows(pii.report(pii.scan(df)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: brute.personal(t) for i, t in want}


def test_terms_that_give_an_entity_away_are_found_and_replaced(spark):
    common = "the quick brown fox jumps over lazy dogs while many others wait here "
    texts = [common * 5 + f"reach agentsmith soon at user{i}@mail{i}.example.com please now " + common for i in range(12)]
    texts += [common * 8 for _ in range(40)] + ["agentsmith was here"] + [texts[0]] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = pii.scan(df)
    got = rows(pii.report(scanned), "n_term", "spans")
    assert got[52][0] == 1 and got[52][1] == "term:0:10"
    assert got[20][0] == 0
    clean = {r[0]: r[1] for r in scanned.select("doc_id", pii.sanitised(scanned).alias("t")).collect()}
    assert "agentsmith" not in clean[0] and "example.com" not in clean[0] and "<email>" in clean[0]
    assert clean[20] == texts[20]


def test_terms_that_go_with_a_single_entity_are_found(spark):
    rng = np.random.default_rng(5)
    filler = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 2)) + " the lazy dog waits" for _ in range(25))
    texts = [f"{filler()} write to Agentsmith at only.one@mail.example.com now {filler()}" for _ in range(6)]
    copied = f"{filler()} write to Agentjones at other.one@mail.example.com now {filler()}"
    texts += [copied] * 20 + [filler() for _ in range(40)] + ["AGENTSMITH was in \u0130zmir"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = pii.scan(df)
    clean = {r[0]: r[1] for r in scanned.select("doc_id", pii.sanitised(scanned).alias("t")).collect()}
    assert not any("Agentsmith" in clean[i] or "only.one" in clean[i] for i in range(6))
    assert "Agentjones" in clean[10]  # copies of one text are no support
    assert clean[66].strip() == "was in \u0130zmir" and clean[40] == texts[40]


def test_lower_case_keeps_the_places_of_all_characters(spark):
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    blocks = spark.createDataFrame([("a ".join(points[i : i + 997]),) for i in range(0, len(points), 997)], "t string")
    assert blocks.where(F.length(pii._lowered(F.col("t"))) != F.length("t")).count() == 0


def test_secrets(pairs):
    want, df = pairs
    got = rows(secrets.report(secrets.scan(df, secrets.train(df))), "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == {i: brute.secret(t) for i, t in want}


def test_texts_with_very_many_matches(spark):
    rng = np.random.default_rng(4)
    value = lambda n: "".join(rng.choice(list("ABCDEFGHabcdefgh0123456789"), n))
    texts = [
        " ".join(f"token={value(30)}" if i % 2 else value(30) for i in range(6_000)),
        " ".join(f"u{i}@m{i % 7}.com é" for i in range(10_000)),
        "x" + value(30) + "_AKIA" + "Z" * 20 + "_" + value(30),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = df.select("doc_id", F.size(common.matches(F.col("text"), pii.EMAIL)).alias("n"))
    start = time.perf_counter()
    assert rows(found, "n")[1] == (10_000,)
    always = secrets.scan(df, [1.0] * 128 * 128)
    got = rows(secrets.report(always), "n_assign", "n_access", "n_hex", "base_sha256", "n_markov", "spans")
    assert time.perf_counter() - start < 60
    assert {i: r[:4] for i, r in got.items()} == {i: brute.secret(t) for i, t in enumerate(texts)}
    assert got[0][4] == 3_000
    # what a base match leaves of a token is judged as a token of its own
    assert got[2][5] == "markov:0:32,access:32:56,markov:56:87"
    base = brute.personal(texts[1])
    scanned = df.where("doc_id = 1").select("doc_id", "text", *[c.alias(k) for k, c in pii.base_spans(F.col("text")).items()])
    scanned = scanned.withColumn("term", F.array().cast("array<struct<start:int,end:int,hit:string,instead:string>>"))
    assert rows(pii.report(scanned), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")[1] == base
    assert scanned.select(pii.sanitised(scanned)).first()[0] == " ".join(["<email> é"] * 10_000)
    red = always.where("doc_id <> 1").select("doc_id", secrets.redact(always).alias("t")).collect()
    assert {r[0]: r[1] for r in red} == {0: " ".join(["[SECRET]"] * 6_000), 2: "[SECRET]" * 3}


def test_markov_models_tell_random_strings_from_identifiers(spark):
    rng = np.random.default_rng(1)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    value = lambda n: "".join(rng.choice(letters, n))
    plain = "internationalization of configuration and documentation standards remains understandable "
    texts = [plain * 3 + f"token = {value(40)} " for _ in range(60)] + [plain + value(32), plain + "understandableconfigurationdocumentation"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = secrets.scan(df, secrets.train(df))
    got = rows(secrets.report(scanned), "n_markov")
    assert got[60] == (1,) and got[61] == (0,)
    red = {r[0]: r[1] for r in scanned.select("doc_id", secrets.redact(scanned).alias("t")).collect()}
    assert red[60] == plain + "[SECRET]" and red[61] == texts[61] and red[0].count("[SECRET]") == 1


def test_quality_measures(pairs):
    want, df = pairs
    measured = quality.measure(df.selectExpr("doc_id", "text", "'en' as lang"))
    got = rows(measured.withColumn("failed", quality.base_failed()), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")
    assert got == {i: brute.quality(t) for i, t in want}


def test_exact_binomial_bound(spark):
    from math import comb, log

    cases = [(100, 0), (100, 3), (400, 5), (37, 37), (1, 0)]
    df = spark.createDataFrame(cases, "n bigint, k bigint").withColumn("p", quality._log_binomial_cdf(*map(__import__("pyspark").sql.functions.col, "nk"), 0.05))
    for n, k, p in df.collect():
        assert p == pytest.approx(log(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))), abs=1e-9)


def test_quality_cutoffs_keep_good_and_reject_bad(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(60)) for _ in range(2500)]
    bad = [" ".join(word() + "%%%" for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2500)) for i in range(2500)], "doc_id bigint, quality int")
    got = rows(quality.assess(df, labels), "kept", "failed_rules")
    assert sum(not got[i][0] for i in range(2500)) <= 0.02 * 2500
    assert not any(got[i][0] for i in range(2500, 2530)) and "symbol_share" in got[2510][1]
    few = quality.assess(df, labels.where("doc_id < 20"))  # too few labels for any cutoff
    assert few.where("kept").count() == 2530


def test_quality_cutoffs_of_small_languages(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    n = quality.least_good(3) + 5
    rows_ = []
    for lang, size in (("fr", n), ("de", quality.least_good(3) - 5), ("zz", 2 * n)):
        long = "x" * 40 if lang == "zz" else ""  # a language whose words are always long
        rows_ += [(" ".join(word() + long for _ in range(60)), lang, 1) for _ in range(size)]
        rows_ += [(" ".join(word() + long + "%" * (60 if long else 3) for _ in range(60)), lang, 0) for _ in range(10)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(rows_)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(rows_)], "doc_id bigint, quality int")
    got = rows(quality.assess(df, labels), "kept")
    kept = {(lang, q): [got[i][0] for i, r in enumerate(rows_) if r[1:] == (lang, q)] for lang in ("fr", "de", "zz") for q in (0, 1)}
    assert not any(kept["fr", 0]) and not any(kept["zz", 0]) and all(kept["de", 0])
    assert all(kept["fr", 1]) and all(kept["de", 1]) and np.mean(kept["zz", 1]) >= 0.98


def test_license_phrases(pairs):
    want, df = pairs
    got = rows(licenses.scan(df), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: brute.phrases(t) for i, t in want}


def test_clauses_are_found_and_pieces_of_edited_notices_are_joined(spark):
    rng = np.random.default_rng(6)
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))
    mit = licenses.TEMPLATES["mit"].split()
    cuts = [" ".join([*mit[: len(mit) // 2], *noise(n).split(), *mit[len(mit) // 2 :]]) for n in (4, 6, 10, 30)]
    often = " ".join(" ".join([*mit[i : i + 18], noise(9)]) for i in range(0, len(mit), 18))
    texts = [noise(20) + " " + t + " " + noise(20) for t in (*cuts, often)]
    texts += [licenses.TEMPLATES[name] for name in ("mit-warranty", "bsd-warranty", "bsd-conditions", "isc", "gpl-warranty")]
    texts += [" ".join(mit) + " " + noise(50) + " " + " ".join(mit), " ".join(mit[:30]), noise(400)]
    got = rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")), "labels", "score", "voted_spans")
    n = len(licenses._words(" ".join(mit)))
    assert [got[i][0] for i in range(5)] == ["mit"] * 5
    assert got[3][2] == f"mit:20:{20 + n + 30}"
    assert [got[i][0] for i in range(5, 10)] == ["mit-warranty", "bsd-warranty", "bsd-conditions", "isc", "gpl,gpl-warranty"]
    assert sorted(got[10][2].split(",")) == sorted([f"mit:0:{n}", f"mit:{n + 50}:{2 * n + 50}"])
    assert got[11][:2] == ("", 0.0) and got[12][:2] == ("", 0.0)


def test_licenses_are_voted_with_words_inserted_and_changed(spark):
    mit = licenses.TEMPLATES["mit"]
    broken = mit.replace("free of charge,", "free of any charge at all,").replace("merge", "fuse")
    texts = [(1, f"foo bar {broken} tail"), (2, mit.split("deal")[0][:60]), (3, "nothing to see"), (4, f"foo bar {broken} tail")]
    got = rows(licenses.scan(spark.createDataFrame(texts, "doc_id int, text string")), "labels", "score", "voted_spans")
    assert got[1][0] == "mit" and got[1][1] > 0.8 and got[1][2].startswith("mit:2:")
    assert got[2][0] == "" and got[3] == ("", 0.0, "") and got[4] == got[1]


def test_bpe_equals_the_library(pairs):
    want, df = pairs
    t = bpe.tokenizer(None)
    text = dict(want)
    special = text[0] + "<|endoftext|>" + text[1]
    df = df.unionAll(df.sparkSession.createDataFrame([(-1, special), (-2, text[2] + "'re  " + text[3] + text[2])], df.schema))
    got = rows(bpe.digests(df), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, x in [*want, (-1, special), (-2, text[2] + "'re  " + text[3] + text[2])]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_joins_at_any_place():
    t, fast, rng = bpe.tokenizer(None), bpe.fast_tokenizer(None), np.random.default_rng(3)
    bits = ["'", "'s", "'re", " ", "  ", "\n", "\n\n", "a", "the", " then", "é", "\U0001f600", "23", "!", "\t", "ll", "v", "e", " '", "日本", "_"]
    for n in range(800):
        if n == 400:
            bits = [b for b in bits if not bpe.COMMON.search(b)]
        s = "".join(rng.choice(bits, rng.integers(1, 90)))
        places = sorted({int(p) for p in rng.integers(0, len(s) + 1, 5)})
        shared = [(a, b, t.encode(s[a:b], add_special_tokens=False)) for a, b in zip(places, places[1:], strict=False)]
        shared = [(a, b, e.ids, *bpe.pieces(e)) for a, b, e in shared]
        want = t.encode(s, add_special_tokens=False).ids
        assert bpe.assemble(t, s, shared) == want
        if not bpe.COMMON.search(s):
            assert bpe.assemble(t, s, shared, fast) == want


def test_both_libraries_agree_on_common_characters():
    t, (fast, _), rng = bpe.tokenizer(None), bpe.fast_tokenizer(None), np.random.default_rng(12)
    common = [chr(c) for c in range(0x180) if not bpe.COMMON.search(chr(c))]
    assert len(common) > 300
    for c in common:
        for text in (c, f"a{c}b", f" {c} {c}{c}1", f"{c}'s\n {c}\n\n{c}", f"  {c}  x"):
            assert fast.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(2000):
        text = "".join(rng.choice(common, rng.integers(1, 40)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert fast.encode_ordinary(text) == ids and fast.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_and_shared_chunks(documents):
    some = documents.where("doc_id < 60")
    back = rows(bpe.decode(bpe.encode(some)), "text")
    assert back == rows(some, "text")
    twice = some.unionAll(some).selectExpr("doc_id", "text")
    places, shared = bpe._chunk_places(twice.selectExpr("1L as k1", "2L as k2", "text"))
    assert 0 < bpe._shared_tokens(twice, shared, None).count() == shared.count() == places.select("h").distinct().count()


def test_bpe_moves_no_readings_for_copies_of_a_text(documents, monkeypatch):
    """Only chunks that different texts share are encoded apart; copies of one text are not."""
    moved = []
    tokens = bpe._shared_tokens
    monkeypatch.setattr(bpe, "_shared_tokens", lambda read, shared, path: moved.append(shared.count()) or tokens(read, shared, path))
    some = documents.where("length(text) > 500").limit(20).selectExpr("doc_id", "text").localCheckpoint()
    mixed = some.unionAll(some).unionAll(some)
    once, thrice = bpe.digests(some).collect(), bpe.digests(mixed).collect()
    assert sorted(thrice) == sorted(3 * once)
    assert moved[0] == moved[1]


def test_toxicity_learns_and_ignores_ids_and_languages(spark, documents):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows_ = []
    for i in range(900):
        toxic = i % 5 == 0
        text = [str(w) for w in rng.choice(words, 40)]
        if toxic:
            text[int(rng.integers(40))] = "zzvile" + str(rng.choice(["", "ly", "ness"]))
        rows_.append((i, " ".join(text), "en" if i % 2 else "fr", int(toxic)))
    df = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string, toxic int")
    got = toxicity.assess(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    truth = {r[0]: r[3] for r in rows_}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    renamed = toxicity.score(df.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang"), toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic")), ["doc_id"])
    by_id = {r["doc_id"] - 7: r["score"] for r in renamed.collect()}
    assert all(abs(by_id[r["doc_id"]] - r["score"]) < 1e-9 for r in got)


def test_long_texts_do_not_end_the_toxicity_sample(spark, monkeypatch):
    texts = ["long " * 9_000 if i % 10 == 0 else f"short text {i}" for i in range(200)]
    df = spark.createDataFrame([(i, t, "en", i % 2) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, langs: seen.extend(texts))
    toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"))
    known = df.where(~toxicity.held_out(F.col("doc_id")) & (F.length("text") < 100))
    assert sorted(seen) == sorted(r["text"] for r in known.collect())


def test_mixing_follows_the_law(spark):
    df = spark.createDataFrame([(i, "x" * 10, "big" if i % 3 else "small") for i in range(6000)], "doc_id bigint, text string, source string")
    mixed = mixing.mix(df, targets={"big": 0.5, "small": 0.5})
    got = {r["source"]: r for r in mixing.weights_met(mixed).collect()}
    assert abs(got["big"]["copies"] - 3000) < 200 and abs(got["small"]["copies"] - 3000) < 200
    copies = mixed.groupBy("doc_id", "source").count().where("source = 'small'")
    assert copies.where("count >= 4").count() > 50  # Poisson(1.5) has a tail
    assert mixing.mix(df, targets={}).count() == 0
    order = [r[0] for r in mixed.where("doc_id < 400").select("doc_id").collect()]
    assert order != sorted(order)


def test_poisson_table(spark):
    from math import exp, factorial

    df = spark.range(1).select(mixing.poisson_table(__import__("pyspark").sql.functions.lit(2.5)).alias("t"))
    table = df.first()[0]
    want = np.cumsum([exp(-2.5) * 2.5**k / factorial(k) for k in range(20)])
    assert np.allclose(table[:20], want) and table[-1] == pytest.approx(1.0)


def test_pieces_of_a_long_chunk_are_read_in_one_go():
    """Its offsets are asked for once; asked for by piece, 12,000 tokens took over 7 s."""
    e = bpe.tokenizer(None).encode("some words of a chunk, and more. " * 1_500, add_special_tokens=False)
    begin = time.perf_counter()
    at, first = bpe.pieces(e)
    assert len(e.ids) > 12_000 and time.perf_counter() - begin < 0.5
    assert [e.offsets[int(first[-1])][0]] == [int(at[-1])]
