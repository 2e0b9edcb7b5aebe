from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"

#: Texts that operators must take: none, empty, blank, tiny, very long, beyond the basic plane, repeated.
ODD = [
    None, "", " \n\t ", "one", "A b", "a  B", "x" * 30_000, "word " * 9_000, "\U0001f600 café 日本 x@y.zz",
    "a@b.c%x@d.e.f +1 (234) 567-8901 4111 1111 1111 1111 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255",
    "9" * 20_000, "a" * 50_000 + "@", "+1" + " " * 20_000, "1-" * 9_000 + "1",
    "tOkEn : \"abcdef\" AKIA" + "Z" * 20 + " " + "0af" * 30 + " api_key=abc ApiKey=abcdefg",
    "a b c a b c a b c\n\n \nx\nx\n x", "x y z " * 40, "CC-BY cc by4 general  public\nLicense all rights reserved",
    "repeat me", "repeat me",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a row with a null id, a repeated row, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, i, "x", i) for i, t in enumerate(ODD)]
    rows += [(None, "cc by", "en", "s1", 5, 1, "x", 1), (3, "one", "en", "s0", 3, 3, "x", 3)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score bigint, term string, _text bigint"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="session")
def pairs(documents, odd_docs):
    """(id, text) of all documents with an id, the odd ones shifted; as rows and as a frame."""
    odd = odd_docs.where("doc_id is not null").selectExpr("doc_id + 1000000 as doc_id", "text").distinct()
    df = documents.select("doc_id", "text").unionAll(odd)
    return [tuple(r) for r in df.collect()], df
