"""Extracts, references, masters and registers made from the given tables.

The dirt in them (padding, blanks, extra fields, bad numbers) depends on column values,
and every frame covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ORD
from ..sources.lines import lines_from_table
from ..sources.local import local_frame

NBSP = "\u00a0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- text extracts ---------------------------------------------------------------------

ORDER_TITLES = "ID|KODE_UKER|STATUS|AMOUNT_IN_IDR|REGION"


def order_text(orders: DataFrame) -> DataFrame:
    """One text line per order, some of them broken."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    key = F.col("o_custkey").cast("string")
    code = F.when(status == "P", F.concat(F.lit(f" \t{NBSP}"), key, F.lit("  "))).otherwise(key)
    bad = (priority == "2-HIGH") & (status == "F")
    amount = F.when(bad, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2))
    region = F.when((priority == "3-MEDIUM") & (status == "O"), F.lit("nan")).otherwise(
        F.concat(F.lit('"'), F.replace(priority, F.lit("-"), F.lit("|")), F.lit('"'))
    )
    head = F.concat_ws("|", F.col("o_orderkey").cast("string"), code, status, amount)
    line = (
        F.when((priority == "4-NOT SPECIFIED") & (status == "P"), F.lit("   "))
        .when((priority == "5-LOW") & (status == "O"), head)
        .when(priority == "1-URGENT", F.concat(head, F.lit("|x|y")))
        .otherwise(F.concat(head, F.lit("|"), region))
    )
    # Twice the key leaves odd row numbers free for titles and banners.
    return lines_from_table(orders, line, F.col("o_orderkey") * 2)


def with_lines(lines: DataFrame, extra: dict[int, str], src: str = "table") -> DataFrame:
    """Insert fixed lines (titles, banners) at given row numbers."""
    spark = lines.sparkSession
    rows = [(src, 0, n, text) for n, text in extra.items()]
    return lines.unionByName(local_frame(spark, rows, lines.schema))


def dirty_orders(spark, d) -> DataFrame:
    """Title on the first row."""
    return with_lines(order_text(table(spark, d, "orders")), {-1: ORDER_TITLES})


def clean_lines(orders: DataFrame) -> DataFrame:
    line = F.concat_ws(
        "|",
        F.col("o_orderkey").cast("string"),
        F.col("o_custkey").cast("string"),
        "o_orderstatus",
        F.format_string("%.2f", F.col("o_totalprice")),
        "o_orderpriority",
    )
    return lines_from_table(orders, line, F.col("o_orderkey") * 2)


def midfile_orders(spark, d) -> DataFrame:
    """Clean lines, with a banner on top, titles in the middle, and titles once more."""
    lines = clean_lines(table(spark, d, "orders"))
    return with_lines(
        lines, {-3: "MONTHLY VOLUME", 1001: ORDER_TITLES, 2001: ORDER_TITLES.lower(), 2003: "PAGE 2"}
    )


def yearly_orders(spark, d) -> DataFrame:
    """One source per order year, in two column layouts, each with its own title row."""
    orders = table(spark, d, "orders")
    year = F.year("o_orderdate")
    early = year < 1998
    text = lambda c: F.col(c).cast("string")
    amount = F.format_string("%.2f", F.col("o_totalprice"))
    line = F.when(early, F.concat_ws("|", text("o_custkey"), text("o_orderkey"), amount)).otherwise(
        F.concat_ws("|", amount, F.col("o_orderpriority"), text("o_orderkey"), text("o_custkey"))
    )
    lines = lines_from_table(orders, line, F.col("o_orderkey") * 2, year)
    years = orders.select(year.alias("y")).distinct()
    titles = years.select(
        F.col("y").cast("string").alias("src"),
        F.lit(0).cast("long").alias("blk"),
        F.when(F.col("y") < 1998, F.lit(-1)).otherwise(F.lit(501)).cast("long").alias("row"),
        F.when(F.col("y") < 1998, F.lit("KODE_UKER|ID|AMOUNT_IN_IDR"))
        .otherwise(F.lit("AMOUNT_IN_IDR|REGION|ID|KODE_UKER"))
        .alias("line"),
    )
    return lines.unionByName(titles)


def document_files(spark, d) -> DataFrame:
    """Every document as an extract of its own, in one of three encodings.

    ``line`` holds raw bytes, as the text reader delivers them. Lines of French files end in a
    byte that only Windows-1252 gives a character of its own, Spanish ones in one that it does
    not define.
    """
    docs = table(spark, d, "documents")
    narrow = F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    # a level of its own: next to the explode each text would be matched once for each of its lines
    known = docs.select("doc_id", F.when(narrow, F.col("lang")).alias("lang"), "text")
    parts = known.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("n", "t"))
    plain = F.replace(F.replace("t", F.lit("|"), F.lit("/")), F.lit('"'), F.lit("^"))
    cell = F.concat(F.lit("<"), plain, F.lit(">"))
    bytes_of = lambda tail: F.concat(F.encode(cell, "ISO-8859-1"), F.unhex(F.lit(tail)))
    raw = (
        F.when(F.col("lang") == "fr", bytes_of("80"))
        .when(F.col("lang") == "es", bytes_of("81"))
        .otherwise(F.encode(cell, "UTF-8"))
    )
    line = F.concat(F.encode(F.concat(F.col("n").cast("string"), F.lit("|")), "UTF-8"), raw)
    body = lines_from_table(parts, line.cast("string"), F.col("n") + 1, F.col("doc_id"))
    titles = lines_from_table(docs, F.lit("ID|SEGMEN"), F.lit(0), F.col("doc_id"))
    return titles.unionByName(body)


def broken_orders(spark, d) -> DataFrame:
    """Orders with quoted cells over several lines, some across splits, and quotes that mean nothing."""
    orders = table(spark, d, "orders")
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    amount = F.format_string("%.2f", F.col("o_totalprice"))
    urgent = F.array(F.concat(key, F.lit('|"two')), F.lit(""), F.concat(F.lit('"" lines|"|'), amount))
    high = F.array(F.concat(key, F.lit('|"a')), F.concat(F.lit('b"|'), amount))
    stray = F.array(F.concat(key, F.lit('|5" pipe|'), amount))
    plain = F.array(F.concat(key, F.lit('|"c|d"|'), amount))
    parts = (
        F.when(priority == "1-URGENT", urgent)
        .when(priority == "2-HIGH", high)
        .when(priority == "5-LOW", stray)
        .otherwise(plain)
    )
    lines = orders.select("o_orderkey", F.posexplode(parts).alias("n", "line"))
    # row numbers far apart, so that the table falls into many splits, at any line of an order
    numbered = lines_from_table(lines, F.col("line"), (F.col("o_orderkey") * 3 + F.col("n")) * 999)
    return with_lines(numbered, {-1: "ID|SEGMEN|AMOUNT"})


# -- references, masters, registers ----------------------------------------------------


def supplier_reference(spark, d) -> DataFrame:
    """Branch per supplier, for suppliers with a positive balance; the others are misses."""
    s = table(spark, d, "supplier").where(F.col("s_acctbal") >= 0)
    n = table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("KODE_UKER"),
        F.col("n_nationkey").cast("string").alias("MAIN_CODE"),
        F.col("n_name").alias("MAIN_BRANCH"),
        F.col("s_suppkey").alias(ORD),
    )


def customer_reference(spark, d) -> DataFrame:
    """Branch per customer under aliased headers, for customers with a positive balance."""
    c = table(spark, d, "customer").where(F.col("c_acctbal") >= 0)
    n = table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("KANCA"),
        F.col("n_nationkey").cast("string").alias("UNIQUE CODE"),
        F.col("n_name").alias("DESCRIPTION"),
        F.col("c_custkey").alias(ORD),
    )


def user_master(spark, d) -> DataFrame:
    """Branch code per user, with a decoy ``ID`` column and the real ``ID USER``."""
    c = table(spark, d, "customer").where(F.col("c_acctbal") >= 0)
    return c.select(
        (F.col("c_custkey") + 1_000_000).cast("string").alias("ID"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("ID USER"),
        F.col("c_nationkey").cast("string").alias("MAIN_CODE"),
        F.col("c_custkey").alias(ORD),
    )


def register(spark, d) -> DataFrame:
    """Accounts to update: customers; the HOUSEHOLD ones are of the type never updated."""
    c = table(spark, d, "customer")
    household = F.col("c_mktsegment") == "HOUSEHOLD"
    return c.select(
        F.when(F.col("c_nationkey") == 0, F.lit(" ")).otherwise(F.col("c_custkey").cast("string")).alias("NO REK"),
        F.when(household, F.lit(" DEPOSITO ")).otherwise(F.lit("Giro")).alias("JENIS"),
        F.col("c_acctbal").alias("SALDO"),
        F.col("c_custkey").alias("SALDO UPDATE"),
        F.col("c_custkey").alias("ROW_NO"),
    )


def monthly(spark, d) -> DataFrame:
    """Balances: every order is a line for its customer's account; some are no numbers."""
    o = table(spark, d, "orders")
    amount = F.format_string("%.2f", F.col("o_totalprice"))
    return o.select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("NO REK"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.format_number("o_totalprice", 2))
        .when(F.col("o_orderstatus") == "F", F.lit("-"))
        .otherwise(amount)
        .alias("SALDO IDR"),
        F.col("o_orderkey").alias(ORD),
    )


# -- raw tables of the reports ---------------------------------------------------------


def volume_rows(spark, d) -> DataFrame:
    """Line items as branch volumes."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("KODE_UKER"),
        F.col("l_returnflag").alias("SEGMEN"),
        F.col("l_linestatus").alias("SOURCE"),
        F.col("l_quantity").alias("FBI"),
        F.col("l_extendedprice").alias("VOLUME_IN_IDR"),
    )


def trade_rows(spark, d) -> DataFrame:
    """Line items as trade amounts; blank segments among them."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.when(flag == "R", F.lit("WholeSale ")).when(flag == "N", F.lit("")).otherwise(F.lit("Kecil")).alias("SEGMEN"),
        F.col("l_suppkey").cast("string").alias("MAINBR"),
        F.concat(F.lit("Branch "), F.col("l_suppkey").cast("string")).alias("MBDESC"),
        F.col("l_extendedprice").alias("AMOUNT_IN_IDR"),
    )


def guarantee_rows(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("MAINBR"),
        F.concat(F.lit("Branch "), F.col("o_custkey").cast("string")).alias("MBNAME"),
        F.col("o_totalprice").alias("AMOUNT_IN_IDR"),
    )


def static_rows(spark, d) -> DataFrame:
    """Orders as products per unit: corporate ones, other regions, blank product ids."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("KODE_UNIT"),
        F.when(status == "F", F.lit("Korporasi")).when(status == "P", F.lit("")).otherwise(F.lit("SME")).alias("SEGMEN"),
        F.when(priority == "5-LOW", F.lit("KANWIL SURABAYA"))
        .when(priority == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .otherwise(F.lit(" kanwil malang")).alias("KW"),
        F.when(F.year("o_orderdate") == 2000, F.lit("  "))
        .otherwise(F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))).alias("ID_PRODUCT"),
    )


def account_rows(spark, d) -> DataFrame:
    """Orders as virtual-account volumes, with a third of the amount so cents appear."""
    return table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.lit("WHOLESALE")).otherwise(F.lit("NonWholesale")).alias("SEGMEN"),
        F.col("o_custkey").cast("string").alias("KODE UKER"),
        (F.col("o_totalprice") / 4).alias("VOLUME_IDR"),
    )


def activity_source(spark, d) -> DataFrame:
    """Events as transactions: large ones count as one, the others as none."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.when(kind == "error", F.lit(" cms ")).otherwise(F.upper(kind)).alias("SOURCE"),
        F.when(kind == "view", F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0")))
        .otherwise(F.col("user_id").cast("string")).alias("ID"),
        F.when(F.col("value") >= 120, F.lit(1.0)).otherwise(F.lit(0.0)).alias("FREKUENSI"),
        kind.alias("KODE_UKER"),
        F.col("event_id").alias(ORD),
    )


def event_reference(spark, d) -> DataFrame:
    """Context branch per event type."""
    kinds = table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias(ORD))
    return kinds.select(
        F.col("event_type").alias("KODE_UKER"),
        F.upper(F.substring("event_type", 1, 2)).alias("MAIN_CODE"),
        F.col("event_type").alias("MAIN_BRANCH"),
        ORD,
    )


def segments(spark, d) -> DataFrame:
    """Customers with their segment in mixed case and padding, blank or missing."""
    seg, n = F.col("c_mktsegment"), F.col("c_nationkey")
    value = (
        F.when(F.col("c_acctbal") < 0, F.lit("  "))
        .when(F.col("c_acctbal") > 9000, F.lit(None).cast("string"))
        .when(n < 8, F.lower(seg))
        .when(n < 16, F.concat(F.lit(f"{NBSP} "), seg, F.lit("\t")))
        .otherwise(seg)
    )
    return table(spark, d, "customer").select("c_custkey", value.alias("SEGMEN"), "c_nationkey")
