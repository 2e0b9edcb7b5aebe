from __future__ import annotations

import contextlib
import csv
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F

from branchtally.driver import inputs
from branchtally.errors import EmptyInputError, ExtractError
from branchtally.sources import parse_lines, parse_table, pick_source, read_extract, read_lines
from branchtally.sources import extract as extract_module
from branchtally.sources import records
from branchtally.sources.extract import header_note
from branchtally.sources.local import local_frame


def rows(extract):
    data = extract.data
    names = [c for c in data.columns if c != "_ord"]
    return [tuple(r[n] for n in names) for r in data.orderBy("_ord").collect()]


def one_metrics(extract):
    return extract.metrics().drop("src").first().asDict()


def test_titles_on_the_first_row(spark, text_file):
    path = text_file("KODE_UKER|SEGMEN|VOLUME_IN_IDR\n  0001  | Wholesale |1,250\n0002|Retail|bad\n")
    e = read_extract(spark, path, numeric_columns=["VOLUME_IN_IDR"])
    assert e.columns == ("KODE_UKER", "SEGMEN", "VOLUME_IN_IDR")
    assert rows(e) == [("0001", "Wholesale", 1250.0), ("0002", "Retail", 0.0)]
    assert one_metrics(e) == {"total_rows": 2, "malformed_rows": 0, "header_row": 1}


def test_long_rows_are_rejected_and_short_rows_padded(spark, text_file):
    path = text_file(
        "KODE_UKER|SEGMEN|VOL\n0001|A|1\n0002|Cor|porate|5\n0003|B\n0004|C|4|\n\n   \n"
        '0005|"x|y"|5\n"0006"|"x ""y"" z"|6|\n0007|a"b|7\n'
    )
    e = read_extract(spark, path)
    assert rows(e) == [("0001", "A", "1"), ("0003", "B", ""), ("0005", "x|y", "5"), ("0007", 'a"b', "7")]
    assert one_metrics(e)["malformed_rows"] == 3
    assert [r["line"] for r in e.rejects.orderBy("row").collect()] == [
        "0002|Cor|porate|5", "0004|C|4|", '"0006"|"x ""y"" z"|6|',
    ]


def test_kept_and_dropped_lines_add_up(spark, text_file):
    lines = ["BANNER", "a|b|c", "kode uker|SEGMEN|VOL", "1|x|2", "1|2|3|4", "", "KODE_UKER|SEGMEN|VOL", "|only|"]
    e = read_extract(spark, text_file("\n".join(lines) + "\n"))
    verdicts = {r[0]: r[1] for r in e.tagged.groupBy("_verdict").count().collect()}
    assert sum(verdicts.values()) == len(lines)
    # With titles below the first row, lines with a single filled cell are banners too.
    assert verdicts == {"title": 1, "data": 2, "malformed": 1, "banner": 4}


def test_titles_in_the_middle_keep_both_sides(spark, text_file):
    path = text_file(
        "B01|One|100\nB02|Two|200\nMAINBR|MBNAME|AMOUNT_IN_IDR\nB03|Three|300\nB04|Four|400\n"
    )
    e = read_extract(spark, path, numeric_columns=["AMOUNT_IN_IDR"])
    assert rows(e) == [("B01", "One", 100.0), ("B02", "Two", 200.0), ("B03", "Three", 300.0), ("B04", "Four", 400.0)]
    assert one_metrics(e)["header_row"] == 3
    assert "row 3" in header_note(3) and header_note(1) is None


def test_banner_above_titles(spark, text_file):
    path = text_file("Rincian Volume\n\nperiode juni\nMAINBR|MBNAME|AMOUNT_IN_IDR\nB01|One|1\nB02|Two|2\n")
    e = read_extract(spark, path)
    assert rows(e) == [("B01", "One", "1"), ("B02", "Two", "2")]
    assert one_metrics(e)["header_row"] == 4


def test_deep_titles(spark, text_file):
    body = [f"B{n}|Name {n}|{n}" for n in range(398)]
    path = text_file("\n".join([*body, "MAINBR|MBNAME|AMOUNT_IN_IDR", "B999|Last|9"]) + "\n")
    e = read_extract(spark, path)
    assert one_metrics(e) == {"total_rows": 399, "malformed_rows": 0, "header_row": 399}


def test_unmatched_titles_fall_back_to_the_first_filled_line(spark, text_file):
    e = read_extract(spark, text_file("\nfoo|bar\n1|2\nfoo|bar\n"))
    assert e.columns == ("FOO", "BAR")
    assert rows(e) == [("1", "2"), ("foo", "bar")]


def test_required_columns_extend_the_hints(spark, text_file):
    path = text_file("x|y\nfoo|bar\n1|2\n")
    assert read_extract(spark, path, title_hints=["FOO", "bar"]).columns == ("FOO", "BAR")


@pytest.mark.parametrize(
    "text, encoding",
    [("Wholesalé", "utf-8"), ("Wholesalé", "utf-8-sig"), ("Wholesalé €", "cp1252"), ("Wholesalé \x81", "latin-1")],
)
def test_encodings(spark, text_file, text, encoding):
    path = text_file(f"KODE_UKER|SEGMEN|VOL\n0001|{text}|1\n0002|plain|2\n", encoding=encoding)
    assert [r[1] for r in rows(read_extract(spark, path))] == [text, "plain"]


def test_one_encoding_per_file(spark, tmp_path):
    # The second line is valid UTF-8 on its own, but the file as a whole is not; and it
    # holds a byte that Windows-1252 does not define.
    (tmp_path / "a.txt").write_bytes(b"KODE_UKER|SEGMEN\n1|caf\xe9\n2|\xc3\x81\n")
    got = [r[1] for r in rows(read_extract(spark, str(tmp_path / "a.txt")))]
    assert got == ["café", "Ã\x81"]


@pytest.mark.parametrize("content", ["", "KODE_UKER|SEGMEN\n", "\n\n", "KODE_UKER|SEGMEN\n|\n  | \n"])
def test_empty_inputs_are_refused(spark, text_file, content):
    with pytest.raises(EmptyInputError):
        read_extract(spark, text_file(content)).require_rows()


def test_many_files_with_their_own_layouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("KODE_UKER|VOL\n1|10\n2|20\n")
    (tmp_path / "in" / "b.txt").write_text("banner\nVOL|SEGMEN|KODE_UKER\n30|X|3\n40|Y|4|5\n")
    e = read_extract(spark, str(tmp_path / "in"), numeric_columns=["VOL"])
    assert e.columns == ("KODE_UKER", "VOL", "SEGMEN")
    assert rows(e) == [("1", 10.0, ""), ("2", 20.0, ""), ("3", 30.0, "X")]
    assert sorted(tuple(r)[1:] for r in e.metrics().collect()) == [(1, 1, 2), (2, 0, 1)]


def test_more_files_than_the_driver_should_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extract_module, "MAX_LOCAL_FILES", 2)
    (tmp_path / "in").mkdir()
    for n in range(5):
        titles = "KODE_UKER|VOL" if n < 3 else "VOL|KODE_UKER"
        line = f"{n}|1" if n < 3 else f"1|{n}"
        (tmp_path / "in" / f"{n}.txt").write_text(f"{titles}\n{line}\n")
    got = rows(read_extract(spark, str(tmp_path / "in")))
    assert sorted(got) == [(str(n), "1") for n in range(5)]


def test_split_files_keep_their_order(spark, text_file):
    body = "".join(f"{n}|{n % 7}|x\n" for n in range(20000))
    path = text_file("ID|KODE_UKER|SEGMEN\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert read_lines(spark, path).rdd.getNumPartitions() > 4
        e = read_extract(spark, path)
        assert [r[0] for r in rows(e)] == [str(n) for n in range(20000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def sheet(spark, *rows):
    width = max(map(len, rows))
    schema = "n long, " + ", ".join(f"c{i} string" for i in range(width))
    return local_frame(spark, [(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)], schema)


def test_sheet_with_titles_anywhere(spark):
    e = parse_table(
        sheet(spark, ("LAPORAN",), ("1", "a", "5"), ("KODE_UKER", " Segmen", "VOL"), ("2", None, "6")),
        order_by="n",
        numeric_columns=["VOL"],
    )
    assert rows(e) == [("1", "a", 5.0), ("2", "", 6.0)]


def test_source_pick_prefers_matched_titles(spark):
    plain = sheet(spark, ("p", "q"), ("1", "2"))
    titled = sheet(spark, ("KODE_UKER", "VOL"), ("1", "2"))
    empty = sheet(spark, ("KODE_UKER", "VOL"))
    assert pick_source([("a", plain), ("b", empty), ("c", titled)], order_by="n")[0] == "c"
    assert pick_source([("b", empty), ("a", plain)], order_by="n")[0] == "a"
    with pytest.raises(EmptyInputError):
        pick_source([("b", empty)], order_by="n")


def many_layouts(folder, n):
    """Files with columns of their own in an order of their own; every fifth quotes its titles."""
    folder.mkdir()
    for i in range(n):
        names = ["KODE_UKER", f"C{i % 600}", "VOL"]
        turn = i % 3
        names = names[turn:] + names[:turn]
        cells = {"KODE_UKER": str(i), f"C{i % 600}": f"own {i}", "VOL": "1"}
        titles = "|".join(f'"{c}"' if i % 5 == 0 else c for c in names)
        (folder / f"{i:05d}.txt").write_text(f"{titles}\n" + "|".join(cells[c] for c in names) + "\n")


@pytest.mark.parametrize("local", [10_000, 100])
def test_any_number_of_layouts_parses_like_one(spark, tmp_path, monkeypatch, local):
    """600 layouts; with their facts on the driver and, as with over 10,000 files, stored."""
    monkeypatch.setattr(extract_module, "MAX_LOCAL_FILES", local)
    many_layouts(tmp_path / "in", 600)
    e = read_extract(spark, str(tmp_path / "in"), numeric_columns=["VOL"])
    assert len(e.columns) == 602
    got = e.data.selectExpr("KODE_UKER", "VOL", "C7", "C599", "C13").collect()
    want = [(str(i), 1.0, *(f"own {i}" if i == c else "" for c in (7, 599, 13))) for i in range(600)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert e.ingest() == (0, 1)


def test_layouts_are_data_not_plan(spark, tmp_path):
    """The plan does not grow with the layouts: a cell is looked up by its row's own position."""
    orders = list(itertools.permutations(["KODE_UKER", "VOL", "A", "B", "C"]))

    def plan(n):
        (tmp_path / str(n)).mkdir()
        for i, names in enumerate(orders[:n]):
            (tmp_path / str(n) / f"{i:03d}.txt").write_text("|".join(names) + "\n" + "|".join(c.lower() for c in names) + "\n")
        e = read_extract(spark, str(tmp_path / str(n)))
        assert set(map(tuple, e.data.select("VOL", "A", "KODE_UKER").collect())) == {("vol", "a", "kode_uker")}
        return e.data.select("VOL")._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(110)) < 1.1 * len(plan(3))


def test_a_title_cell_of_any_length(spark, text_file):
    long = "x" * 200_000
    e = read_extract(spark, text_file(f'KODE_UKER|VOL|"{long}"\n1|2|3\n'))
    assert e.columns[:2] == ("KODE_UKER", "VOL") and len(e.columns[2]) == 200_000 and e.data.count() == 1


@pytest.mark.parametrize("local", [10_000, 1])
def test_files_of_blank_lines_have_no_metrics_row(spark, tmp_path, monkeypatch, local):
    """However many files have titles."""
    monkeypatch.setattr(extract_module, "MAX_LOCAL_FILES", local)
    for name, text in (("a", "KODE_UKER|VOL\n1|2\n"), ("b", "\n  \n")):
        (tmp_path / f"{name}.txt").write_text(text)
    e = read_extract(spark, str(tmp_path))
    assert [r["total_rows"] for r in e.metrics().collect()] == [1] and e.ingest() == (0, 1)
    (tmp_path / "c.txt").write_text("banner\nVOL|KODE_UKER\n1|2\n")
    e = read_extract(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in e.metrics().collect()) == [(1, 0, 1), (1, 0, 2)]


def test_plan_has_no_python_and_no_shuffle(spark, text_file):
    e = read_extract(spark, text_file("KODE_UKER|SEGMEN\n1|a\n"))
    plan = e.data._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_declared_encoding(spark, text_file):
    path = text_file("caf\u00e9\nKODE_UKER|SEGMEN\n1|\u00e9\n", encoding="cp1252")
    e = read_extract(spark, path, encoding="cp1252")
    assert rows(e) == [("1", "\u00e9")] and one_metrics(e)["header_row"] == 2


def test_declared_encoding_with_deep_titles(spark, text_file):
    body = "".join(f"{n}|x\n" for n in range(1500))
    e = read_extract(spark, text_file(body + "KODE_UKER|SEGMEN\n"), encoding="utf-8")
    assert e.columns == ("KODE_UKER", "SEGMEN") and e.data.count() == 1500


@contextlib.contextmanager
def splits_of(spark, size):
    """Text is read in splits of ``size`` bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, size)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("encoding, mark", [("utf-8", "\u00e9"), ("cp1252", "\u20ac")])
def test_quoted_line_breaks(spark, text_file, encoding, mark):
    path = text_file(
        f'top\nKODE_UKER|SEGMEN|VOL\n1|"two\nlines {mark}"|5\n2|b\n3|c|d|e\n4|"x|y"|6\n', encoding=encoding
    )
    e = read_extract(spark, path, numeric_columns=["VOL"])
    assert rows(e) == [("1", f"two\nlines {mark}", 5.0), ("2", "b", 0.0), ("4", "x|y", 6.0)]
    assert one_metrics(e) == {"total_rows": 3, "malformed_rows": 1, "header_row": 2}


def cells_with_breaks(n):
    """(text of a file, its rows): cells with line breaks, blank lines, doubled and stray quotes in them."""
    rnd, lines, want = random.Random(n), ["ID|SEGMEN|VOL|KW"], []
    for i in range(n):
        cell = rnd.choice(["plain", f'a"b {i}', 'q "" q', "two\nlines", f'x\n\n{i} "y"|z\n', "|", "end\n" * 30, '"', "é\né"])
        quoted = "\n" in cell or "|" in cell or cell.startswith('"') or rnd.random() < 0.3
        other = rnd.choice(["k", "K 1", "a\nb"])
        text = lambda c, q: '"' + c.replace('"', '""') + '"' if q else c
        lines.append(f"{i}|{text(cell, quoted)}|{i % 5}|{text(other, chr(10) in other)}")
        want.append((str(i), cell.strip(), float(i % 5), other))
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("size", ["128m", "700", "64"])
def test_records_cross_splits(spark, tmp_path, size):
    """The same rows for any splits, several files and encodings; the csv module reads the same records."""
    (tmp_path / "in").mkdir()
    want = []
    for n, encoding in ((150, "utf-8"), (90, "cp1252"), (40, "latin-1")):
        text, expected = cells_with_breaks(n)
        (tmp_path / "in" / f"{n}.txt").write_bytes((text + ("" if encoding != "latin-1" else "\x81||0|\n")).encode(encoding))
        assert [tuple(c.strip() for c in r) for r in csv.reader(io.StringIO(text, newline=""), delimiter="|")][1:] == [
            (a, b, str(int(c)), d.strip()) for a, b, c, d in expected
        ]
        want += [(f"{n}.txt", *r) for r in expected] + ([(f"{n}.txt", "\x81", "", 0.0, "")] if encoding == "latin-1" else [])
    (tmp_path / "in" / "plain.txt").write_text("x|y\nID|SEGMEN|VOL|KW\n7|s|1|k\n")
    want += [("plain.txt", "x", "y", 0.0, ""), ("plain.txt", "7", "s", 1.0, "k")]
    with splits_of(spark, size):
        assert size == "128m" or read_lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 8
        e = read_extract(spark, str(tmp_path / "in"), numeric_columns=["VOL"])
        got = [(r[0].src.rsplit("/", 1)[1], *r[1:]) for r in e.data.select("_ord", "ID", "SEGMEN", "VOL", "KW").orderBy("_ord").collect()]
        assert sorted(got) == sorted(want)
        assert [r[1:] for r in got if r[0] == "150.txt"] == [r[1:] for r in want if r[0] == "150.txt"]
        assert e.rejects.count() == 0


def test_unclosed_quotes_swallow_nothing(spark, text_file):
    path = text_file('ID|SEGMEN|VOL\n1|"a\nb"|5\n2|"open|6\n3|c|7\n4|"d|8\n')
    e = read_extract(spark, path, numeric_columns=["VOL"])
    assert [r for r in rows(e) if r[0] in ("1", "3")] == [("1", "a\nb", 5.0)]  # closed by the quote of row 4, as any CSV reader has it
    path = text_file('ID|SEGMEN|VOL\n1|"a\nb"|5\n2|"open|6\n3|c|7\n', name="b.txt")
    e = read_extract(spark, path, numeric_columns=["VOL"])
    assert [r for r in rows(e) if r[0] != "2"] == [("1", "a\nb", 5.0), ("3", "c", 7.0)]


def test_a_cell_that_never_seems_to_close_is_an_error(spark, text_file, monkeypatch):
    monkeypatch.setattr(records, "RECORD_BYTES", 1_000)
    path = text_file('ID|SEGMEN\n1|"open\n' + "2|x\n" * 400 + '3|"y"\n')
    with pytest.raises(ExtractError, match="quoted cell"):
        read_extract(spark, path)


@pytest.mark.parametrize("delimiter", ["|", ",", "||"])
def test_quote_effects_by_hand(spark, delimiter):
    """Each line's effect on an open quote, against a character-by-character reading."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(['"', '"', delimiter, "a"]) for _ in range(rnd.randrange(9))) for _ in range(1500)]

    def after(text, inside):
        i, start = 0, not inside
        while i < len(text):
            if inside:
                if text[i : i + 2] == '""':
                    i += 1
                elif text[i] == '"':
                    inside, start = False, False
            elif text.startswith(delimiter, i):
                start, i = True, i + len(delimiter) - 1
            elif start and text[i] == '"':
                inside, start = True, False
            else:
                start = False
            i += 1
        return inside

    df = local_frame(spark, [(t,) for t in texts], "line string")
    got = df.select("line", *records.quote_effects(F.col("line"), delimiter)).collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(t, after(t, False), after(t, True)) for t in texts]


def test_title_row_does_not_depend_on_splits(spark, tmp_path):
    for n in range(2):
        body = "\n".join(f"{i}|K{i % 7}|{i}" for i in range(1500 * (n + 1)))
        (tmp_path / f"f{n}.txt").write_text(f"{body}\nID|KODE_UKER|VOLUME\n{body}\n")
    found = set()
    for size in ("128m", "5000", "801"):
        with splits_of(spark, size):
            e = read_extract(spark, str(tmp_path))
            found.add(tuple(sorted(r["header_row"] for r in e.metrics().collect())))
        # found under one way of splitting, counted under another
        assert sorted(r["header_row"] for r in e.metrics().collect()) == [1501, 3001]
    assert found == {(1501, 3001)}


def test_titles_below_other_lines_survive_other_splits(spark, tmp_path):
    """A cluster may split the files differently for the second pass; titles are known by their text."""
    for n in range(3):
        rows = "\n".join(f"{n}{i:05d}|K{i % 7}|{i}" for i in range(3000))
        (tmp_path / f"f{n}.txt").write_text(f"report of the day\n\nID|KODE_UKER|VOLUME\n{rows}\nID|KODE_UKER|VOLUME\n9|K1|1\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    extract = read_extract(spark, str(tmp_path), numeric_columns=["VOLUME"])
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = extract.data.select("ID", "VOLUME").collect()
        assert extract.ingest()[0] == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == 9003 and not [r for r in rows if r["ID"] == "ID"]
    assert sum(r["VOLUME"] for r in rows) == 3 * (2999 * 1500 + 1)


def test_a_text_is_matched_once_however_many_lines_it_has(spark, tmp_path):
    """The encoding rule of a document is asked below the explode into lines, not next to it."""
    spark.createDataFrame([(1, "fr", "a|b\n\"c\"")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = inputs.document_files(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("RLIKE")
    assert sorted(r["line"] for r in lines.selectExpr("decode(cast(line as binary), 'ISO-8859-1') as line").collect()) == ["0|<a/b>\x80", "1|<^c^>\x80", "ID|SEGMEN"]


def test_titles_of_many_files_are_found_in_one_pass(spark, tmp_path, monkeypatch):
    """Whether the facts on the files fit on the driver or are stored, the text is read once for them."""
    monkeypatch.setattr(extract_module, "MAX_LOCAL_FILES", 1)
    monkeypatch.setattr(extract_module, "has_checkpoint_dir", lambda spark: True, raising=False)
    read = tmp_path / "read"

    def noted(batches):
        for batch in batches:
            with read.open("a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    rows = [(s, 0, n, line) for s in "abc" for n, line in enumerate(["ID|AMOUNT", "1|2"])]
    lines = spark.createDataFrame(rows, "src string, blk long, row long, line string").mapInArrow(noted, "src string, blk long, row long, line string")
    data = parse_lines(lines, numeric_columns=["AMOUNT"]).data
    assert len(read.read_text()) == len(rows)
    assert sorted((r["_ord"]["src"], r["ID"], r["AMOUNT"]) for r in data.collect()) == [(s, "1", 2.0) for s in "abc"]


@pytest.mark.parametrize("line, titled", [
    ("id  |x", True), ("x| amount", True), ("x|AMOUNT_IN_IDR\x1c|", True), ("", False),
    ("identity|amounts", False), ("x id|y", False), ("a|i d", False), ("x|\nID", True), ("ID\n", True),
])
def test_a_line_may_be_titles_if_a_whole_cell_is_one(spark, line, titled):
    may = extract_module._may_be_title(F.col("line"), "|", extract_module.hint_set())
    assert spark.createDataFrame([(line,)], "line string").select(may).first()[0] is titled
