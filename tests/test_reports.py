from __future__ import annotations

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from branchtally.errors import ReportValidationError
from branchtally.operators.activity import ACTIVE, INACTIVE
from branchtally.plans import REPORTS, FilterChoice, get_report, run_job, run_report
from branchtally.plans.spec import filter_options, resolve_filters
from branchtally.sources import Delivery, Extract, read_extract
from branchtally.sources.local import local_frame

ACCUMULATED = (
    "KODE_UKER|SEGMEN|FBI|VOLUME_IN_IDR\n0001|Wholesale|100|1250000000000\n0002|Corporate|50.25|500000000.50\n"
    "0001|Wholesale|200|250000000000\n0003|Retail|10|1000000\n"
)
STATIC = (
    "KODE_UNIT|SEGMEN|KW|ID_PRODUCT\n0001|Consumer|KANWIL MALANG|P1\n0001|Micro|kanwil malang|P1\n"
    "0001||KANWIL MALANG|P2\n0001|SME|KANWIL MALANG|   \n0002|SME|KANWIL MALANG|P3\n"
    "0001|KORPORASI|KANWIL MALANG|P4\n0001|korporasi|KANWIL MALANG|P5\n0002|Consumer|KANWIL SURABAYA|P6\n"
    "0002|Consumer||P7\n0009|Consumer|KANWIL MALANG|P8\n"
)
USERS = (
    "SOURCE|ID|FREKUENSI|KODE_UKER\nQCASH|U1|3|K1\nQIB| U1|4|K1\nCMS|U1|100|K1\nQCASH|U2|2|K2\n"
    "QCASH|U3|5|K1\nQCASH|U4|1|K2\nQCASH|U5|9|K1\nCMS|U6|10|K1\n"
)


def run(spark, text_file, report_id, content, reference=None, master=None, choice=None):
    spec = get_report(report_id)
    extract = read_extract(
        spark, text_file(content), numeric_columns=spec.numeric_columns, title_hints=spec.required_columns
    )
    return run_report(spec, extract.data, reference, master, choice)


def table(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_accumulated(spark, text_file, reference):
    result = run(spark, text_file, "akumulasi", ACCUMULATED, reference)
    assert table(result.summary, "MAIN_CODE", "Sum of FBI", "VOLUME_IN_IDR") == [
        ("MC10", 300, 1_500_000_000_000), ("MC20", 50, 500_000_000), ("UNMAPPED", 10, 1_000_000),
        ("Grand Total", 360, 1_500_501_000_000),
    ]
    assert result.metrics.first().asDict() == {
        "processed_rows": 4, "kept_rows": 4, "unmapped_rows": 1, "total_value": 1500501000000.5, "branch_count": 3,
    }
    assert "_ord" not in result.detail.columns and result.detail.count() == 4
    assert sum(r["VOLUME_IN_IDR"] for r in result.branches.collect()) == 1500501000000.5


def test_accumulated_in_dashboard_order(spark, text_file, frame):
    raw = "KODE_UKER|FBI|VOLUME_IN_IDR\nU110|10|1000\nU13|20|2000\nU7|30|3000\n"
    ref = frame("KODE_UKER,MAIN_CODE,MAIN_BRANCH", ("U7", "7", "a"), ("U13", "13", "b"), ("U110", "110", "c"))
    result = run(spark, text_file, "akumulasi", raw, ref)
    assert [r[0] for r in table(result.summary, "MAIN_CODE")] == ["7", "13", "110", "Grand Total"]


def test_trade_volume(spark, text_file):
    raw = (
        "SEGMEN|MAINBR|MBDESC|AMOUNT_IN_IDR\nWholesale|B01|Branch One|1000\nCorporate|B01|Branch One|2000\n"
        "Retail|B02|Branch Two|500\n|B02|Branch Two|300\nWholesale|B03|Branch Three|9999\n"
    )
    result = run(spark, text_file, "rincian-vol-tf", raw)
    assert table(result.summary, "MAINBR", "MBDESC", "AMOUNT_IN_IDR") == [
        ("B01", "Branch One", 2000), ("B02", "Branch Two", 800), ("Grand Total", None, 2800),
    ]
    lines = {r["item"]: r["value"] for r in result.metadata.collect()}
    assert lines["Total Records Processed:"] == "3" and lines["Filter Applied:"] == "Wholesale (excluded)"
    everything = run(spark, text_file, "rincian-vol-tf", raw, choice=FilterChoice(segment_drop=[]))
    assert table(everything.summary, "AMOUNT_IN_IDR")[-1] == (13799,)


def test_guarantee_has_no_filters(spark, text_file):
    raw = "MAINBR|MBNAME|AMOUNT_IN_IDR\nB01|One|1000\nB01|One|2000\nB02|Two|500\n"
    result = run(spark, text_file, "rincian-portal-bg", raw, choice=FilterChoice(segment_keep=["x"], kw_keep=["x"]))
    assert table(result.summary, "MAINBR", "AMOUNT_IN_IDR") == [("B01", 3000), ("B02", 500), ("Grand Total", 3500)]
    assert {r["item"]: r["value"] for r in result.metadata.collect()}["Filter Applied:"] == "None (All Segments)"


@pytest.mark.parametrize("key", ["KODE UKER", "KODE_UKER", "UKER"])
def test_virtual_account_volume(spark, text_file, reference, key):
    raw = (
        f"SEGMEN|{key}|VOLUME_IDR\nNONWHOLESALE|0001|1481517421603.75\nNONWHOLESALE|0002|1000000000000\n"
        "WHOLESALE|0001|999999999999\n"
    )
    result = run(spark, text_file, "timeseries-fbi-briva", raw, reference)
    assert table(result.summary, "MAIN_CODE", "Sum of VOLUME_IDR") == [
        ("MC10", 1481517421604), ("MC20", 1000000000000), ("Grand Total", 2481517421604),
    ]


def test_static_count(spark, text_file, reference):
    result = run(spark, text_file, "report-data-statis", STATIC, reference)
    assert table(result.summary, "MAIN_CODE", "Count of ID_PRODUCT") == [
        ("MC10", 3), ("MC20", 1), ("UNMAPPED", 1), ("Grand Total", 5),
    ]
    assert sorted(r["ID_PRODUCT"] for r in result.detail.collect()) == ["", "P1", "P1", "P2", "P3", "P8"]
    only = FilterChoice.keep_only(segment=["Korporasi"])
    assert table(run(spark, text_file, "report-data-statis", STATIC, reference, choice=only).summary, "Count of ID_PRODUCT") == [(2,), (2,)]


def user_tables(frame):
    context = frame("KODE_UKER,MAIN_CODE,MAIN_BRANCH", ("K1", "99", "Context"), ("K2", "99", "Context"))
    master = frame("ID,MAIN_CODE", ("U1", "7"), ("U2", "7"), ("U3", "9"), ("U4", "7"), ("U6", "9"))
    return context, master


def test_active_users(spark, text_file, frame):
    context, master = user_tables(frame)
    result = run(spark, text_file, "timeseries-active-user-qlola", USERS, context, master)
    assert table(result.summary, "MAIN_CODE", ACTIVE, INACTIVE, "Grand Total") == [
        ("7", 1, 2, 3), ("9", 1, 0, 1), ("Grand Total", 2, 2, 4),
    ]
    detail = {r["ID"]: (r["UKER_MAIN_CODE"], r["MAIN_CODE"], r["FREKUENSI"]) for r in result.detail.collect()}
    assert detail["U1"] == ("99", "7", 7) and detail["U5"] == ("99", "UNMAPPED", 9) and len(detail) == 5
    assert result.metrics.first().asDict() == {"processed_rows": 8, "ids": 5, "unmapped_ids": 1}
    head = {r["item"]: r["value"] for r in result.metadata.collect()}
    assert head["Unmapped IDs:"] == "1" and head["Filter Applied:"] == "CMS (SOURCE excluded)"


def test_active_users_numeric_ids(spark, text_file, frame):
    context, _ = user_tables(frame)
    master = local_frame(spark, [(1001, "7", 0), (1002, "9", 1)], "ID long, MAIN_CODE string, _ord long")
    raw = "SOURCE|ID|FREKUENSI|KODE_UKER\nQCASH|1001|6|K1\nQCASH|1002.0|2|K1\nQCASH|1003|7|K2\n"
    result = run(spark, text_file, "timeseries-active-user-qlola", raw, context, master)
    assert table(result.summary, "MAIN_CODE", ACTIVE, INACTIVE) == [("7", 1, 0), ("9", 0, 1), ("Grand Total", 1, 1)]


def test_active_users_at_scale(spark, frame):
    context, _ = user_tables(frame)
    ids = [f"U{n}" for n in range(3243)]
    raw = local_frame(spark, [("QCASH", u, 6.0, "K1", i) for i, u in enumerate(ids)], "SOURCE string, ID string, FREKUENSI double, KODE_UKER string, _ord long")
    master = local_frame(spark, [(u, "7", i) for i, u in enumerate(ids[204:])], "ID string, MAIN_CODE string, _ord long")
    result = run_report(get_report("timeseries-active-user-qlola"), raw, context, master)
    assert table(result.summary, ACTIVE)[-1] == (3039,)
    assert result.metrics.first()["unmapped_ids"] == 204


def test_all_users_unmapped(spark, text_file, frame):
    context, _ = user_tables(frame)
    result = run(spark, text_file, "timeseries-active-user-qlola", USERS, context, frame("ID,MAIN_CODE", ("Z", "1")))
    assert table(result.summary, "MAIN_CODE", "Grand Total") == [("Grand Total", 0)]


def test_missing_inputs(spark, text_file, reference):
    with pytest.raises(ReportValidationError, match="reference"):
        run(spark, text_file, "akumulasi", ACCUMULATED).summary
    with pytest.raises(ReportValidationError, match="master"):
        run(spark, text_file, "timeseries-active-user-qlola", USERS, reference)
    with pytest.raises(ReportValidationError, match="FBI"):
        run(spark, text_file, "akumulasi", "KODE_UKER|VOLUME_IN_IDR\n1|2\n", reference)
    with pytest.raises(ReportValidationError, match="akumulasi"):
        get_report("nope")


def test_filter_resolution_and_labels():
    static, volume = get_report("report-data-statis"), get_report("rincian-vol-tf")
    assert resolve_filters(static).label == "KORPORASI (excluded); KANWIL MALANG (KW only)"
    assert resolve_filters(static, FilterChoice(segment_drop=[], kw_keep=[])).label is None
    chosen = FilterChoice(segment_keep=["A", " b "], source_keep=["QIB"], source_drop=["CMS"], kw_keep=["X"])
    assert resolve_filters(static, chosen).label == (
        "A, b (only); KORPORASI (excluded); QIB (SOURCE only); CMS (SOURCE excluded); X (KW only)"
    )
    assert resolve_filters(volume, chosen).label == "A, b (only); Wholesale (excluded)"
    only = FilterChoice.keep_only(source=["CMS"])
    assert resolve_filters(get_report("timeseries-active-user-qlola"), only).label == "CMS (SOURCE only)"
    assert filter_options(volume) == {"SEGMEN": ("Kecil", "Wholesale")}
    assert len(REPORTS) == 7


@pytest.mark.parametrize("staged", [False, True])
def test_job_from_files_to_files(spark, text_file, tmp_path, staged):
    raw = text_file("DAILY EXTRACT\n" + ACCUMULATED + "0001|a|b|c|d\n")
    ref = text_file("KANCA,UNIQUE CODE,DESCRIPTION\n0001,MC10,Jakarta Pusat\n0002,MC20,Surabaya\n0001,late,late\n", "ref.csv")
    out = str(tmp_path / "out")
    done = run_job(
        spark, "akumulasi", raw, out, reference=ref, staging_path=str(tmp_path / "stage") if staged else None
    )
    assert done.error is None and done.success
    assert (done.processed_rows, done.unmapped_rows, done.malformed_rows) == (4, 1, 1)
    assert "row 2" in done.note and done.miss_diagnostic is None
    summary = spark.read.parquet(f"{out}/summary").orderBy("position", "MAIN_CODE")
    assert table(summary, "MAIN_CODE", "Sum of FBI") == [("MC10", 300), ("MC20", 50), ("UNMAPPED", 10), ("Grand Total", 360)]
    assert spark.read.parquet(f"{out}/detail").count() == 4


class Executions:
    """The physical plans of the queries that run inside the block."""

    def __init__(self, spark):
        self.store = spark._jsparkSession.sharedState().statusStore()

    def __enter__(self):
        self.before = self.store.executionsCount()
        return self

    def __exit__(self, *failure):
        time.sleep(0.5)  # the listener is told a little later
        found = self.store.executionsList(int(self.before), 10_000)
        self.plans = [found.apply(i).physicalPlanDescription() for i in range(found.size())]

    def scans(self, file):
        """How many executions read this file."""
        return sum(bool(re.search(rf"InMemoryFileIndex[^\n]*/{file}\b", p)) for p in self.plans)


@pytest.mark.parametrize("report", ["akumulasi", "timeseries-active-user-qlola"])
def test_job_reads_the_text_twice(spark, text_file, tmp_path, report):
    """Once to find the titles and once to parse, however many outputs and counts there are."""
    ref = text_file("KODE_UKER,MAIN_CODE,MAIN_BRANCH\n0001,MC10,Jakarta\n0002,MC20,Surabaya\n", "ref.csv")
    master = text_file("ID,MAIN_CODE\na,MC10\nb,MC20\n", "master.csv")
    raw = ACCUMULATED if report == "akumulasi" else "ID|KODE_UKER|FREKUENSI|SOURCE\na|0001|3|x\na|0001|0|x\nc|0002|1|x\n"
    with Executions(spark) as ran:
        done = run_job(spark, report, text_file(raw), str(tmp_path / "out"), reference=ref, master=master)
    assert done.error is None and done.processed_rows == raw.count("\n") - 1
    assert ran.scans("raw.txt") == 2 and ran.scans("stage") > 2


def test_outputs_come_with_a_manifest_and_nothing_else(spark, text_file, tmp_path):
    ref = text_file("KODE_UKER,MAIN_CODE,MAIN_BRANCH\n0001,MC10,Jakarta\n", "ref.csv")
    done = run_job(spark, "akumulasi", text_file(ACCUMULATED), str(tmp_path / "a" / "out"), reference=ref, staging_path=str(tmp_path / "stage"))
    assert done.success and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["out"]
    manifest = json.loads((tmp_path / "a" / "out" / "_MANIFEST.json").read_text())
    assert manifest["outputs"] == ["summary", "detail", "metadata"] and manifest["processed_rows"] == 4
    assert spark.read.parquet(str(tmp_path / "stage")).where("_verdict = 'data'").count() == 4
    again = run_job(spark, "akumulasi", text_file(ACCUMULATED), str(tmp_path / "a" / "out"), reference=ref)
    assert not again.success and "exists already" in again.error
    assert json.loads((tmp_path / "a" / "out" / "_MANIFEST.json").read_text()) == manifest


@pytest.mark.parametrize("place", ["stage", "summary", "detail", "metadata", "commit"])
def test_a_failure_anywhere_leaves_no_output(spark, text_file, tmp_path, monkeypatch, place):
    ref = text_file("KODE_UKER,MAIN_CODE,MAIN_BRANCH\n0001,MC10,Jakarta\n", "ref.csv")
    write, commit, stored = Delivery.write, Delivery.commit, Extract.stored

    def failing(self, name, df, fmt="parquet"):
        if name == place:  # part of the output is there when it fails
            df = df.withColumn("broken", F.when(F.rand() >= 0, F.raise_error(F.lit("no disk"))))
        return write(self, name, df, fmt)

    def no_commit(self, facts):
        if place == "commit":
            raise OSError("no disk")
        return commit(self, facts)

    def no_stage(self, path):
        if place == "stage":
            raise OSError("no disk")
        return stored(self, path)

    monkeypatch.setattr(Delivery, "write", failing)
    monkeypatch.setattr(Delivery, "commit", no_commit)
    monkeypatch.setattr(Extract, "stored", no_stage)
    out = tmp_path / "out"
    out.mkdir()
    done = run_job(spark, "akumulasi", text_file(ACCUMULATED), str(out / "o"), reference=ref, staging_path=str(out / "s"))
    assert not done.success and "no disk" in done.error and list(out.iterdir()) == []


def test_job_reads_quoted_line_breaks(spark, text_file, tmp_path):
    ref = text_file("KODE_UKER,MAIN_CODE,MAIN_BRANCH\n0001,MC10,Jakarta\n", "ref.csv")
    raw = text_file('KODE_UKER|SEGMEN|FBI|VOLUME_IN_IDR\n0001|"a\nb"|5|1\n0001|c|15|2\n')
    done = run_job(spark, "akumulasi", raw, str(tmp_path / "o"), reference=ref)
    assert done.success and (done.processed_rows, done.malformed_rows) == (2, 0)
    summary = spark.read.parquet(str(tmp_path / "o" / "summary"))
    assert table(summary.where("MAIN_CODE = 'MC10'"), "MAIN_CODE", "Sum of FBI") == [("MC10", 20)]
    assert table(spark.read.parquet(str(tmp_path / "o" / "detail")).orderBy("FBI"), "SEGMEN") == [("a\nb",), ("c",)]


def test_job_failure_writes_nothing(spark, text_file, tmp_path):
    out = tmp_path / "out"
    done = run_job(spark, "akumulasi", text_file("KODE_UKER|FBI|VOLUME_IN_IDR\n"), str(out))
    assert not done.success and done.error.startswith("EmptyInputError") and not out.exists()
    done = run_job(spark, "akumulasi", text_file(ACCUMULATED), str(out))
    assert not done.success and "reference" in done.error and not out.exists()


def test_job_reports_a_broken_lookup(spark, text_file, tmp_path):
    ref = text_file("KODE_UKER,MAIN_CODE,MAIN_BRANCH\nX,MC10,a\n", "ref.csv")
    done = run_job(spark, "akumulasi", text_file(ACCUMULATED), str(tmp_path / "o"), reference=ref, fmt="csv")
    assert done.success and "100.0%" in done.miss_diagnostic and "0001" in done.miss_diagnostic


def test_balance_job(spark, text_file, tmp_path, frame):
    monthly = text_file("laporan,\nNO REK,SALDO IDR\n1.0,2500.5\n1,9\n2,x\n", "monthly.csv")
    register = frame("NO REK,JENIS,SALDO", ("1", "Giro", "5"), ("2", "Giro", "6"), ("3", "Deposito", "7"))
    done = run_job(spark, "report-giro", monthly, str(tmp_path / "o"), master=register)
    assert done.error is None and (done.processed_rows, done.unmapped_rows) == (3, 1)
    got = spark.read.parquet(str(tmp_path / "o" / "summary")).orderBy("NO REK")
    assert table(got, "NO REK", "SALDO", "SALDO UPDATE") == [("1", "5", 2500), ("2", "6", None), ("3", "7", None)]
