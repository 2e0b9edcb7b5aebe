from __future__ import annotations

import decimal
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from branchtally.functions import (
    canonical_branch_code,
    canonical_id,
    clean_cell,
    fold,
    merge_totals,
    money_total,
    parse_balance,
    parse_number,
    settle,
    strip,
    strip_control_chars,
    unique_headers,
    whole_units,
)
from branchtally.functions.text import WHITESPACE
from branchtally.sources.local import local_frame


def apply(spark, fn, values, kind="string"):
    df = local_frame(spark, [(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_strip_is_unicode_strip(spark):
    values = [f"{w}a {w}b{w}" for w in WHITESPACE] + ["", "  ", "x"]
    assert apply(spark, strip, values) == [v.strip() for v in values]
    assert set(WHITESPACE) == {chr(n) for n in range(0x3001) if chr(n).isspace()}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1001.0", "1001"), ("1001.00", "1001"), (" 1001 ", "1001"), ("00123", "00123"),
        ("1001.5", "1001.5"), ("U1", "U1"), (" U1", "U1"), ("", ""), ("1001.", "1001."),
        ("007.0", "007"), ("A.0", "A.0"),
    ],
)
def test_canonical_id(spark, raw, want):
    assert apply(spark, canonical_id, [raw]) == [want]


def test_canonical_branch_code(spark):
    values = ["7", " 007 ", "7.0", "0", "000", "UNMAPPED", "mc10", "0x", "00.0"]
    want = ["7", "7", "7", "0", "0", "UNMAPPED", "MC10", "0X", "0"]
    assert apply(spark, canonical_branch_code, values) == want


def test_numbers(spark):
    values = ["1,000", "2000", "bad", "", None, "1d", "1f", "NaN", "Infinity", "1e400", "-1.5E+3", " 12 ",
              " 7 ", ".5", "5.", "+3", "0x1p3", "1,2,3", "--1", "1e5", "."]
    want = [1000.0, 2000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1500.0, 12.0,
            7.0, 0.5, 5.0, 3.0, 0.0, 123.0, 0.0, 100000.0, 0.0]
    assert apply(spark, parse_number, values) == want
    assert apply(spark, parse_balance, ["1,250", "1250", "-", None]) == [None, 1250.0, None, None]


def test_cells(spark):
    assert apply(spark, clean_cell, [" a ", "nan", " None", "NaT", "NAN", None, "nano"]) == [
        "a", "", "", "", "NAN", "", "nano",
    ]
    assert apply(spark, strip_control_chars, ["a\x00b\x1f\tc\n", "ok"]) == ["ab\tc\n", "ok"]
    assert apply(spark, fold, [" KorporaSI ", None, " "]) == ["korporasi", "", ""]


def test_whole_units(spark):
    values = [0.5, 1.5, 2.5, -0.5, 1.01, None]
    assert apply(spark, whole_units, values, "double") == [0, 2, 2, 0, 1, 0]
    assert apply(spark, lambda c: whole_units(c, "ceil"), values, "double") == [1, 2, 3, 0, 2, 0]


def test_unique_headers():
    assert unique_headers([" a ", "A", "", "b"]) == ["A", "A.1", "UNNAMED: 2", "B"]


def test_money_total_is_exact_in_any_order(spark):
    rng = random.Random(7)
    values = [round(rng.uniform(-1e12, 1e12), 2) for _ in range(2000)] + [0.1] * 30 + [1.25e13, -4194304.5]
    want = sum(decimal.Decimal(repr(v)) for v in values)
    for _ in range(2):
        rng.shuffle(values)
        df = local_frame(spark, [(v,) for v in values], "v double").repartition(7)
        parts = df.groupBy(F.spark_partition_id().alias("p")).agg(money_total("v").alias("t"))
        assert df.agg(money_total("v").alias("t")).select(settle("t")).first()[0] == float(want)
        assert parts.agg(merge_totals("t").alias("t")).select(settle("t")).first()[0] == float(want)


def test_money_total_keeps_huge_and_missing_values(spark):
    df = local_frame(spark, [(1e25,), (None,), (2.005,)], "v double")
    assert df.agg(money_total("v").alias("t")).select(settle("t")).first()[0] == 1e25
    empty = df.where("v < 0").agg(money_total("v").alias("t"))
    assert empty.select(settle("t")).first()[0] == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(10**15), 10**15).map(lambda n: n / 100), min_size=1, max_size=30))
def test_money_total_matches_decimal(spark, values):
    df = local_frame(spark, [(v,) for v in values], "v double")
    want = sum(decimal.Decimal(repr(v)) for v in values)
    got = df.agg(money_total("v").alias("t")).select(settle("t")).first()[0]
    assert got == float(want)


def test_sums_keep_digits_beyond_six(spark):
    df = spark.range(300_000).select((F.lit(1.0) / 3).alias("v"))
    assert df.agg(money_total("v").alias("t")).select(settle("t")).first()[0] == 100_000.0
    odd = spark.createDataFrame([(123456789.12,), (0.1,), (0.2,), (-1e-7,)], "v double")
    assert odd.agg(money_total("v").alias("t")).select(settle("t", None)).first()[0] == 123456789.42
