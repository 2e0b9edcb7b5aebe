from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from branchtally.errors import ColumnResolutionError, ReportValidationError
from branchtally.operators import columns as C
from branchtally.operators.diagnostics import key_sample, miss_message, miss_report
from branchtally.operators.filters import (
    dimension_values,
    filter_dimension,
    filter_kw,
    filter_segment,
    filter_values,
    fold_dimensions,
)
from branchtally.operators.joins import JoinPolicy, hot_keys, left_lookup
from branchtally.operators.lookup import (
    attach_branch,
    first_hit,
    lookup_branch,
    unmapped_counts,
    unmapped_keys,
)
from branchtally.operators.mapping import (
    MappingCandidate,
    best_mapping,
    candidate_overlap,
    id_mapping,
    lookup_id,
    mapping_candidates,
    pick_reference,
)
from branchtally.operators.ordering import sort_for_dashboard
from branchtally.operators.reconcile import monthly_balances, write_back
from branchtally.operators.summarize import report_rows, summarize, with_grand_total
from branchtally.sources.local import local_frame

SHUFFLED = JoinPolicy(broadcast_bytes=-1, hot_share=0.1)


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- names -----------------------------------------------------------------------------


def test_alias_rank_beats_column_order():
    assert C.resolve_alias(["UKER", " kode uker "], C.LOOKUP_KEY_ALIASES) == " kode uker "
    assert C.resolve_alias(["KODE UKER", "kode_uker", "KODE_UKER "], C.LOOKUP_KEY_ALIASES) == "kode_uker"
    assert C.resolve_alias(["X"], C.LOOKUP_KEY_ALIASES) is None
    assert C.aliased_columns(["CIF", "ID", "ID QLOLA"], C.ID_ALIASES) == ["ID", "ID QLOLA", "CIF"]


@pytest.mark.parametrize(
    "headers, key, code, branch",
    [
        (["KANCA", "UNIQUE CODE", "DESCRIPTION"], "KANCA", "UNIQUE CODE", "DESCRIPTION"),
        (["KODE SUB KANCA", "SUB KANCA", "KODE KANCA", "KANCA", "KANWIL", "KODE"], "KANCA", "KODE", "SUB KANCA"),
        (["KODE UNIT", "DESC UNIT", "KODE KANCA", "DESC KANCA"], "KODE UNIT", "KODE KANCA", "DESC KANCA"),
        (["UKER", "MAIN_CODE", "MAIN_BRANCH"], "UKER", "MAIN_CODE", "MAIN_BRANCH"),
    ],
)
def test_reference_columns(headers, key, code, branch):
    assert C.reference_names(headers) == {"KODE_UKER": key, "MAIN_CODE": code, "MAIN_BRANCH": branch}


def test_unresolvable_reference_names_what_it_saw(frame):
    with pytest.raises(ColumnResolutionError, match="ACCOUNT NUMBER"):
        C.rename_reference(frame("ACCOUNT NUMBER,PRODUK,C/C", ("1", "2", "3")))


@pytest.mark.parametrize(
    "headers, target",
    [
        (["NO REK", "SALDO", "SALDO UPDATE"], "SALDO UPDATE"),
        (["NO REK", "SALDO JUNI", "SALDO", "SALDO_UPDATE"], "SALDO_UPDATE"),
        (["SALDO JUNI", "saldo juli", "SALDO"], "saldo juli"),
        (["SALDO", "SALDO AWAL"], "SALDO UPDATE"),
    ],
)
def test_target_column(headers, target):
    assert C.target_column(headers) == target


def test_required_columns(frame):
    with pytest.raises(ReportValidationError, match=r"\['B'\].*\['A'\]"):
        C.require_columns(frame("A", ("1",)), ["A", "B"], "Report")


def test_key_normalisation_of_number_columns(spark):
    df = local_frame(spark, [(7.0, 1), (1234567890.0, 2)], "`KODE UNIT` double, n long")
    assert values(C.normalise_key(df), "KODE_UKER") == [("1234567890.0",), ("7.0",)]


# -- filters ---------------------------------------------------------------------------


@pytest.mark.parametrize("given", [None, "", [], ["", "  "]])
def test_no_values_is_no_filter(frame, given):
    df = frame("SEGMEN", ("A",), ("",))
    assert filter_values(given) == []
    assert filter_segment(df, given, given).count() == 2


def test_keep_and_drop(frame):
    df = frame("SEGMEN,n", (" Retail ", "1"), ("RETAIL", "2"), ("sme", "3"), ("", "4"), (None, "5"))
    assert values(filter_segment(df, include="retail"), "n") == [("1",), ("2",)]
    assert values(filter_segment(df, exclude=[" Retail"]), "n") == [("3",), ("4",), ("5",)]
    everything = {r["n"] for r in df.collect()}
    kept = {r["n"] for r in filter_segment(df, include=["sme"]).collect()}
    dropped = {r["n"] for r in filter_segment(df, exclude=["sme"]).collect()}
    assert kept | dropped == everything and not kept & dropped


def test_alias_fallback_and_absent_column(frame):
    df = frame("PRODUCT,KAWIL", ("a", "x"), ("b", "y"))
    assert values(filter_kw(df, ["A"]), "KAWIL") == [("x",)]
    assert filter_segment(df, include=["nothing"]).count() == 2
    assert filter_dimension(df, ["NONE"], ["a"]).count() == 2


def test_stored_dimension_filter_reaches_the_scan(spark, frame, tmp_path):
    df = frame("SEGMEN,n", (" Retail ", "1"), ("SME", "2"), (None, "3"))
    fold_dimensions(df).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    kept = filter_segment(stored, include=["RETAIL"])
    assert values(kept, "n") == [("1",)]
    assert "In(SEGMEN__FOLDED" in plan(kept) or "EqualTo(SEGMEN__FOLDED" in plan(kept)


def test_dimension_values(frame):
    assert values(dimension_values(frame("KW", (" a",), ("A ",), ("",)), ["KW"]), "value", "rows") == [("", 1), ("A", 2)]
    assert dimension_values(frame("X", ("a",)), ["KW"]).count() == 0


# -- lookups ---------------------------------------------------------------------------


@pytest.mark.parametrize("policy", [JoinPolicy(), SHUFFLED])
def test_lookup_keeps_rows_and_marks_misses(frame, reference, policy):
    raw = frame("KODE UKER,n", (" 0001 ", "1"), ("0003", "2"), ("0001", "3"), ("1", "4"), ("", "5"), (None, "6"))
    got = lookup_branch(raw, reference, policy=policy)
    assert values(got, "n", "MAIN_CODE", "MAIN_BRANCH") == [
        ("1", "MC10", "Jakarta Pusat"), ("2", "UNMAPPED", "UNMAPPED"), ("3", "MC10", "Jakarta Pusat"),
        ("4", "UNMAPPED", "UNMAPPED"), ("5", "UNMAPPED", "UNMAPPED"), ("6", "UNMAPPED", "UNMAPPED"),
    ]


def test_lookup_of_a_hit_without_a_code(frame):
    ref = frame("KODE_UKER,MAIN_CODE,MAIN_BRANCH", ("1", None, "Name"), ("1", "late", "late"))
    attached = attach_branch(frame("KODE_UKER", ("1",), ("2",), ("2",)), ref)
    assert unmapped_counts(attached).first().asDict() == {"matched_rows": 0, "unmapped_rows": 3}
    assert values(unmapped_keys(attached), "KODE_UKER") == [("1",), ("2",)]


def test_lookup_moves_clashing_raw_columns_aside(frame, reference):
    got = lookup_branch(frame("KODE_UKER,MAIN_CODE", ("0001", "old")), reference).first()
    assert (got["RAW_MAIN_CODE"], got["MAIN_CODE"]) == ("old", "MC10")


def test_lookup_without_key_lists_columns(frame, reference):
    with pytest.raises(ReportValidationError, match="'OTHER'"):
        lookup_branch(frame("OTHER", ("1",)), reference)


def test_first_hit_does_not_depend_on_partitions(spark):
    rows = [(str(n % 50), f"v{n}", n) for n in range(5000)]
    df = local_frame(spark, rows, "k string, v string, n long")
    want = sorted((str(k), f"v{k}") for k in range(50))
    for parts in (1, 3, 16):
        mixed = df.orderBy(F.rand(parts)).repartition(parts)
        assert values(first_hit(mixed, ["k"], ["v"], "n"), "k", "v") == want


def test_first_hit_needs_an_order(frame):
    with pytest.raises(ReportValidationError, match="order"):
        first_hit(frame("k,v", ("a", "b")).drop("_ord"), ["k"], ["v"])


def test_one_key_with_a_third_of_all_rows(spark):
    raw = local_frame(
        spark, [("hot" if n % 3 == 0 else f"k{n}", n) for n in range(6000)], "KODE_UKER string, n long"
    ).repartition(6)
    ref = local_frame(
        spark,
        [("hot", "H", "Hot", 0)] + [(f"k{n}", f"c{n}", "b", n) for n in range(0, 6000, 2)],
        "KODE_UKER string, MAIN_CODE string, MAIN_BRANCH string, _ord long",
    )
    assert "hot" in hot_keys(raw, "KODE_UKER", SHUFFLED.hot_share)
    small, large = (lookup_branch(raw, ref, policy=p) for p in (JoinPolicy(), SHUFFLED))
    assert values(small, "n", "MAIN_CODE") == values(large, "n", "MAIN_CODE")
    assert large.where("MAIN_CODE = 'H'").count() == 2000


def test_miss_diagnostic(frame, reference):
    raw = frame("KODE_UKER", *[(f"X{n}",) for n in range(7)])
    report = miss_report(attach_branch(raw, reference), "MAIN_CODE").first().asDict()
    assert report == {"total_rows": 7, "unmapped_rows": 7, "unmapped_share": 1.0, "warn": True}
    sample = [r["key"] for r in key_sample(raw, "KODE_UKER").orderBy("position").collect()]
    assert sample == ["X0", "X1", "X2", "X3", "X4"]
    text = miss_message("lookup", 7, 7, sample, ["0001"], ["KODE_UKER"])
    assert "100.0%" in text and "(7/7)" in text and "X4" in text and "0001" in text
    assert miss_message("lookup", 98, 100, [], [], []) is None
    assert miss_message("lookup", 0, 0, [], [], []) is None
    assert miss_report(attach_branch(raw.limit(0), reference), "MAIN_CODE").first()["warn"] is False


# -- choosing tables -------------------------------------------------------------------


def test_reference_pick(frame):
    ledger = frame("ACCOUNT NUMBER,DESCRIPTION,UNIQUE CODE", ("1", "2", "3"))
    units = frame("KODE SUB KANCA,SUB KANCA,KODE KANCA,KANCA,KODE", ("1", "2", "3", "4", "5"))
    new = frame("KODE UNIT,DESC UNIT,KODE KANCA,DESC KANCA", ("1", "2", "3", "4"))
    tables = [("Mapping GL", ledger), ("Unit Kerja", units), ("UKER NEW 2025", new)]
    assert pick_reference(tables)[0] == "UKER NEW 2025"
    assert pick_reference([("B", units), ("A", units)])[0] == "B"
    with pytest.raises(ColumnResolutionError, match="Mapping GL"):
        pick_reference(tables[:1])


def test_best_mapping_goes_by_overlap_then_preference(frame):
    master = frame(
        "ID,ID QLOLA,MAIN_CODE",
        ("9001", "1001.0", "7"), ("9002", "1002", "9"), ("9003", " 1001", "late"), ("9004", "", "x"), ("nan", "1005", None),
    )
    probe = frame("ID", ("1001",), ("1002",), ("1003",), ("1005",))
    winner, mapping = best_mapping([("MASTER", master)], probe)
    assert winner.id_column == "ID QLOLA"
    assert values(lookup_id(probe.drop("_ord"), mapping), "ID", "MAIN_CODE") == [
        ("1001", "7"), ("1002", "9"), ("1003", "UNMAPPED"), ("1005", "UNMAPPED"),
    ]
    assert best_mapping([("MASTER", master)])[0].id_column == "ID"
    assert values(id_mapping(best_mapping([("M", master)])[0]), "ID")[0] == ("9001",)
    with pytest.raises(ColumnResolutionError, match="MAIN_CODE"):
        mapping_candidates([("t", frame("ID,OTHER", ("1", "2")))])


def test_overlap_counts_many_candidates_without_a_join(frame):
    headers = [f"ID {n}" for n in range(70)]
    first = frame("ID,MAIN_CODE", ("a", "1"), ("a", "2"), ("b", "3"), ("", "4"), (None, "5"))
    found = [MappingCandidate(h, first.withColumnRenamed("ID", h), h, "MAIN_CODE") for h in headers]
    found.append(MappingCandidate("none", frame("ID,MAIN_CODE", ("z", "1")), "ID", "MAIN_CODE"))
    counted = candidate_overlap(found, frame("ID", ("a",), ("a",), ("c",), ("nan",), (None,)))
    assert sorted(map(tuple, counted.collect())) == [(n, 1) for n in range(70)]
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_best_mapping_over_several_tables(frame):
    first = frame("ID,MAIN_CODE", ("a", "1"))
    second = frame("USER ID,KODE INDUK", ("a", "2"), ("b", "3"))
    winner, _ = best_mapping([("COVER", first), ("x", second)], frame("ID", ("a",), ("b",)))
    assert winner.table == "x"
    assert best_mapping([("COVER", first), ("DATA", first)], frame("ID", ("z",)))[0].table == "DATA"


# -- summaries -------------------------------------------------------------------------


def test_summary_counts_sums_and_totals(frame):
    df = frame("g,c,v", ("x", "P1", "1.005"), ("x", "P1", "2"), ("x", " ", "bad"), (None, None, "1,000"), ("", "p", "5"))
    assert sorted((str(r[0]), r[1]) for r in summarize(df, ["g"], ["c"], "count").collect()) == [("", 1), ("None", 0), ("x", 2)]
    sums = summarize(df, ["g"], ["v"])
    assert sorted((str(r[0]), r[1]) for r in sums.collect()) == [("", 5.0), ("None", 0.0), ("x", 3.0)]
    total = with_grand_total(sums, ["g"], ["v"]).where("row_kind = 'total'").collect()
    assert [(r["g"], r["v"]) for r in total] == [(None, 8.0)]
    with pytest.raises(ReportValidationError, match="nope"):
        summarize(df, ["g"], ["nope"])


def test_summary_reuses_one_shuffle_for_the_total(frame):
    sums = summarize(frame("g,v", ("a", "1"), ("b", "2")), ["g"], ["v"])
    rows = with_grand_total(sums, ["g"], ["v"])
    rows.collect()
    assert "ReusedExchange" in plan(rows)


def test_rounded_rows_may_exceed_the_rounded_total(frame):
    df = frame("MAIN_CODE,v", ("a", "1.2"), ("b", "1.2"))
    rows = report_rows(summarize(df, ["MAIN_CODE"], ["v"]), ["MAIN_CODE"], ["v"], "ceil").collect()
    assert [(r["MAIN_CODE"], r["v"]) for r in rows] == [("a", 2), ("b", 2), ("Grand Total", 3)]


def test_dashboard_order(frame):
    df = frame("MAIN_CODE", *[(c,) for c in ("zz", "110", "13", "551", "UNMAPPED", " 007", "177.0", "aa")])
    got = [r["MAIN_CODE"] for r in sort_for_dashboard(df, "MAIN_CODE", ["MAIN_CODE"]).collect()]
    assert got == [" 007", "13", "177.0", "110", "551", "UNMAPPED", "aa", "zz"]
    assert sort_for_dashboard(df, "absent") is df


# -- balances --------------------------------------------------------------------------


def test_first_numeric_balance(frame):
    monthly = frame("NO REK,SALDO IDR", ("1.0", "x"), ("1", "5"), ("1", "6"), ("2", "1,000"), ("", "9"), ("nan", "9"))
    assert values(monthly_balances(monthly), "account", "balance") == [("1", 5.0)]


@pytest.mark.parametrize("policy", [JoinPolicy(), SHUFFLED])
def test_write_back(frame, policy):
    register = frame(
        "NO REK,JENIS,SALDO,SALDO UPDATE",
        ("1234567890", "Giro", "1000", None), ("2222222222", "Giro", "500", None),
        ("3333333333", " deposito", "300", None), ("4444444444", "Giro", "900", "old"),
        ("5555555555", "giro", "100", None), ("  ", "Giro", "0", "note"),
    )
    monthly = frame(
        "NO REK,SALDO IDR",
        ("1234567890.0", "2500"), ("2222222222", "7500.5"), ("3333333333", "999"),
        ("5555555555", "1250000000000"), ("5555555555", "1"), ("9999999999", "42"),
    )
    done = write_back(register, monthly, policy=policy)
    assert [(r["NO REK"], r["SALDO UPDATE"]) for r in done.register.orderBy("_ord").collect()] == [
        ("1234567890", "2500"), ("2222222222", "7500"), ("3333333333", None), ("4444444444", "old"),
        ("5555555555", "1250000000000"), ("  ", "note"),
    ]
    assert done.counts().first().asDict() == {"scanned_rows": 5, "unmatched_rows": 1, "updated_rows": 3}
    assert done.register.columns == register.columns


def test_write_back_adds_the_column_and_needs_accounts(frame):
    monthly = frame("NO_REK,SALDO", ("1", "2.5"))
    done = write_back(frame("JENIS,NO REK,SALDO", ("Giro", "1", "9"), ("Giro", "7", "9")), monthly)
    assert done.target == "SALDO UPDATE"
    assert [tuple(r) for r in done.register.drop("_ord").orderBy("NO REK").collect()] == [("Giro", "1", "9", 2), ("Giro", "7", "9", None)]
    with pytest.raises(ColumnResolutionError, match="account"):
        write_back(frame("X", ("1",)), monthly)
    with pytest.raises(ColumnResolutionError, match="KODE PRODUK"):
        monthly_balances(frame("KODE PRODUK,KETERANGAN", ("A", "B")))


def test_a_large_lookup_scans_the_left_side_once_and_deals_hot_keys(spark, tmp_path):
    """A third of the rows hold one key: they spread over tasks, and all rows come out once."""
    left = spark.range(9_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else string(id % 500) end as K", "'pad' as P")
    left.repartition(8).write.parquet(str(tmp_path / "left"))
    spark.range(400).selectExpr("string(id) as K", "id as V").unionAll(spark.sql("select 'hot', 77777L")).write.parquet(str(tmp_path / "right"))
    left, right = spark.read.parquet(str(tmp_path / "left")), spark.read.parquet(str(tmp_path / "right"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = left_lookup(left, right, "K", SHUFFLED)
        text = found._jdf.queryExecution().executedPlan().toString()
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        rows_ = sorted(map(str, found.select("id", "K", "V").collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert text.count("/left]") == 1 and text.count("Join") == 1 and "SortMergeJoin" in text
    assert max(sizes) < 9_000 / 3 / 2  # the hot key alone has 3,000 rows
    want = left.join(F.broadcast(right), "K", "left").select("id", "K", "V").collect()
    assert rows_ == sorted(map(str, want)) and len(rows_) == 9_000 and found.columns == ["K", "id", "P", "V"]
