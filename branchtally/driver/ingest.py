"""Queries for reading extracts: titles, rejects, cell cleanup, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import EmptyInputError
from ..functions import clean_cell, parse_number, strip_control_chars
from ..sources import discover_titles, parse_lines, parse_table, pick_source
from ..sources.local import local_frame
from . import inputs
from .register import registry

QUERIES, ORACLES, query = registry()

_URGENT = "o_orderpriority = '1-URGENT'"
_BLANK = "(o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P')"
_BAD = "(o_orderpriority = '2-HIGH' and o_orderstatus = 'F')"
_SHORT = "(o_orderpriority = '5-LOW' and o_orderstatus = 'O')"
_TOKEN = "(o_orderpriority = '3-MEDIUM' and o_orderstatus = 'O')"

_HINTS = ("ID", "KODE_UKER", "AMOUNT_IN_IDR")


def _dirty(spark, d):
    return parse_lines(inputs.dirty_orders(spark, d), numeric_columns=["AMOUNT_IN_IDR"])


def _midfile(spark, d):
    return parse_lines(inputs.midfile_orders(spark, d), numeric_columns=["AMOUNT_IN_IDR"])


@query(f"""
select cast(o_orderkey as varchar) as "ID", cast(o_custkey as varchar) as "KODE_UKER",
       o_orderstatus as "STATUS",
       case when {_BAD} then 0.0 else o_totalprice end as "AMOUNT_IN_IDR",
       case when {_SHORT} or {_TOKEN} then '' else replace(o_orderpriority, '-', '|') end as "REGION"
from orders where not {_URGENT} and not {_BLANK}
""")
def scan_delimited(spark, d):
    """The parsed table of an extract with every kind of damage."""
    return _dirty(spark, d).data.drop("_ord")


@query("""
select 'table' as src, 'utf-8' as encoding, 'ID|KODE_UKER|STATUS|AMOUNT_IN_IDR|REGION' as title,
       cast(1001 as bigint) as title_row, true as matched, true as promoted,
       count(*) as data_lines
from orders
""")
def header_discovery(spark, d):
    """The title row in the middle of the file, found over all lines."""
    lines = inputs.midfile_orders(spark, d)
    titles = discover_titles(lines).select("src", "encoding", "title", "title_row", "matched", "promoted")
    # All lines but the banner, two title rows and a page marker.
    size = lines.groupBy("src").agg((F.count(F.lit(1)) - 4).alias("data_lines"))
    return titles.join(size, "src")


@query("""
select cast(o_orderkey as varchar) as "ID", cast(o_custkey as varchar) as "KODE_UKER",
       o_orderstatus as "STATUS", o_totalprice as "AMOUNT_IN_IDR", o_orderpriority as "REGION",
       o_orderkey * 2 < 1001 as above_titles
from orders
""")
def header_midfile_keep_both_sides(spark, d):
    """S3: rows above and below the titles are all data."""
    data = _midfile(spark, d).data
    return data.withColumn("above_titles", F.col("_ord.row") < 1001).drop("_ord")


@query("""
select 'banner' as verdict, cast(3 as bigint) as lines
union all select 'title', cast(1 as bigint)
union all select 'data', count(*) from orders
""")
def drop_banner_rows(spark, d):
    """A banner, a page marker and a repeated title row are not data."""
    return _midfile(spark, d).tagged.groupBy(F.col("_verdict").alias("verdict")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(f"""
select cast(o_orderkey * 2 as bigint) as row,
       concat_ws('|', o_orderkey, case when o_orderstatus = 'P'
           then ' ' || chr(9) || chr(160) || o_custkey || '  ' else cast(o_custkey as varchar) end,
         o_orderstatus, format('{{:,.2f}}', o_totalprice), 'x', 'y') as line
from orders where {_URGENT}
""")
def malformed_rows(spark, d):
    """Rows with more fields than titles, kept apart as they were read."""
    return _dirty(spark, d).rejects.select("row", "line")


@query(f"""
select case when {_URGENT} then 'malformed' when {_BLANK} then 'blank' else 'data' end as verdict,
       count(*) as lines
from orders group by 1
union all select 'title', cast(1 as bigint)
""")
def drop_blank_rows(spark, d):
    """What became of every line; blank ones are dropped, not rejected."""
    return _dirty(spark, d).tagged.groupBy(F.col("_verdict").alias("verdict")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("""
select p_partkey,
       case when p_type in ('SMALL', 'MEDIUM') then '' when p_type = 'LARGE' then 'NONE' else p_name end as cell
from part
""")
def cell_cleanup(spark, d):
    """Trimmed cells; exact null tokens are blank, look-alikes stay."""
    kind, name = F.col("p_type"), F.col("p_name")
    cell = (
        F.when(kind == "SMALL", F.lit(" nan\t"))
        .when(kind == "MEDIUM", F.lit(None).cast("string"))
        .when(kind == "LARGE", F.lit("NONE"))
        .when(kind == "PROMO", F.concat(F.lit("\t  "), name, F.lit(" \r")))
        .otherwise(name)
    )
    return inputs.table(spark, d, "part").select("p_partkey", clean_cell(cell).alias("cell"))


@query("""
select o_orderkey,
       case when o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED') then 0.0
            when o_orderpriority = '5-LOW' then -o_totalprice else o_totalprice end as amount
from orders
""")
def numeric_coercion(spark, d):
    """Commas and padding are fine, anything else that is no number is 0."""
    p = F.col("o_orderpriority")
    plain = F.format_string("%.2f", F.col("o_totalprice"))
    cell = (
        F.when(p == "1-URGENT", F.format_number("o_totalprice", 2))
        .when(p == "2-HIGH", F.concat(F.lit("  "), plain, F.lit(" ")))
        .when(p == "3-MEDIUM", F.concat(plain, F.lit("d")))
        .when(p == "4-NOT SPECIFIED", F.lit("NaN"))
        .otherwise(F.concat(F.lit("-"), plain, F.lit("e0")))
    )
    return inputs.table(spark, d, "orders").select("o_orderkey", parse_number(cell).alias("amount"))


@query("""
select count(*) as orders_read, true as titles_only_refused, false as full_refused from orders
""")
def empty_input_guard(spark, d):
    """Titles without rows are refused; the same titles with rows are not."""

    def refused(lines):
        try:
            parse_lines(lines).require_rows()
        except EmptyInputError:
            return True
        return False

    lines = inputs.dirty_orders(spark, d)
    full = refused(lines)
    titles_only = refused(lines.where(F.col("line") == inputs.ORDER_TITLES))
    return inputs.table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("orders_read"),
        F.lit(titles_only).alias("titles_only_refused"),
        F.lit(full).alias("full_refused"),
    )


@query("""
select 'customers' as picked, cast(c_custkey as varchar) as "ID", c_mktsegment as "SEGMEN",
       c_acctbal as "AMOUNT" from customer
""")
def source_candidate_pick(spark, d):
    """Of three tables without usable names, the one with a title row among its rows."""

    def cells(df, order, *columns):
        texts = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
        return df.select(*texts, F.col(order).cast("long").alias("n"))

    regions = cells(inputs.table(spark, d, "region"), "r_regionkey", "r_regionkey", "r_name")
    nations = cells(inputs.table(spark, d, "nation"), "n_nationkey", "n_nationkey", "n_name")
    customers = cells(
        inputs.table(spark, d, "customer"), "c_custkey", "c_custkey", "c_mktsegment", "c_acctbal"
    ).withColumn("n", F.col("n") * 2)
    titles = local_frame(spark, [("id", " Segmen ", "AMOUNT", 41)], customers.schema)
    name, extract = pick_source(
        [("cover", regions), ("notes", nations), ("customers", customers.unionByName(titles))],
        order_by="n",
        numeric_columns=["AMOUNT"],
    )
    return extract.data.drop("_ord").withColumn("picked", F.lit(name))


@query(f"""
select 'table' as src, count(*) filter (where not {_URGENT} and not {_BLANK}) as total_rows,
       count(*) filter (where {_URGENT}) as malformed_rows, cast(1 as bigint) as header_row
from orders
""")
def ingest_metrics(spark, d):
    """Rows kept, rows rejected, where the titles were."""
    return _dirty(spark, d).metrics()


@query("""
select 'table' as src, count(*) as total_rows, cast(0 as bigint) as malformed_rows,
       count(*) filter (where o_orderkey * 2 < 1001) + 2 as header_row
from orders
""")
def ingest_metrics_midfile(spark, d):
    """The 1-based title row counts every line above it."""
    return _midfile(spark, d).metrics()


@query("""
select d.doc_id, cast(u.i - 1 as varchar) as "ID",
  '<' || translate(list_extract(d.lines, cast(u.i as bigint)), '|"', '/^') || '>'
    || case when not narrow then '' when lang = 'fr' then '€' when lang = 'es' then chr(129) else '' end as "SEGMEN"
from (select doc_id, lang, string_split(text, chr(10)) as lines,
        regexp_full_match(text, '[\\x00-\\x7F\\x{A0}-\\x{FF}]*') as narrow from documents) d,
  lateral (select unnest(generate_series(1, len(d.lines))) as i) u
""")
def encoding_fallback(spark, d):
    """Each file in the one encoding that reads all of it; cells come out unharmed."""
    extract = parse_lines(inputs.document_files(spark, d))
    return extract.data.select(F.col("_ord.src").cast("long").alias("doc_id"), "ID", "SEGMEN")


@query("""
select cast(o_orderkey as varchar) as "ID", o_totalprice as "AMOUNT",
       case o_orderpriority when '1-URGENT' then 'two' || chr(10) || chr(10) || '" lines|' when '2-HIGH' then 'a' || chr(10) || 'b'
            when '5-LOW' then '5" pipe' else 'c|d' end as "SEGMEN"
from orders
""")
def quoted_line_breaks(spark, d):
    """Cells that hold line breaks are read as one record, across splits too."""
    return parse_lines(inputs.broken_orders(spark, d), numeric_columns=["AMOUNT"]).data.drop("_ord")


@query("""
select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as text from documents
""", name="strip_control_chars")
def strip_control_characters(spark, d):
    """Control characters injected into whole documents are taken out again."""
    docs = inputs.table(spark, d, "documents")
    noisy = F.concat(F.lit("\x07"), F.replace("text", F.lit(" "), F.lit(" \x00\x1f")), F.lit("\x0b"))
    return docs.select("doc_id", strip_control_chars(noisy).alias("text"))


@query("""
select cast(year(o_orderdate) as varchar) as src, cast(o_orderkey as varchar) as "ID",
       cast(o_custkey as varchar) as "KODE_UKER", o_totalprice as "AMOUNT_IN_IDR",
       case when year(o_orderdate) < 1998 then '' else o_orderpriority end as "REGION"
from orders
""")
def union_extracts(spark, d):
    """Many files in two layouts, each with titles in its own place, as one table."""
    extract = parse_lines(
        inputs.yearly_orders(spark, d), numeric_columns=["AMOUNT_IN_IDR"], title_hints=_HINTS
    )
    return extract.data.withColumn("src", F.col("_ord.src")).drop("_ord")


@query("""
select cast(year(o_orderdate) as varchar) as src, count(*) as total_rows, cast(0 as bigint) as malformed_rows,
       case when year(o_orderdate) < 1998 then 1
            else count(*) filter (where o_orderkey * 2 < 501) + 1 end as header_row
from orders group by year(o_orderdate)
""")
def ingest_metrics_per_file(spark, d):
    """S16 over many files."""
    return parse_lines(inputs.yearly_orders(spark, d), title_hints=_HINTS).metrics()


@query("""
select o_orderkey as "ID", o_custkey as "KODE_UKER", o_totalprice as "AMOUNT" from orders
""")
def promote_titles_in_table(spark, d):
    """S3 on a table loaded cell by cell: titles between its rows, nothing lost."""
    orders = inputs.table(spark, d, "orders")
    cells = orders.select(
        F.col("o_orderkey").cast("string").alias("c0"),
        F.col("o_custkey").cast("string").alias("c1"),
        F.format_string("%.2f", F.col("o_totalprice")).alias("c2"),
        (F.col("o_orderkey") * 2).alias("n"),
    )
    titles = local_frame(spark, [("ID", "KODE UKER", "AMOUNT", 77)], cells.schema)
    data = parse_table(cells.unionByName(titles), order_by="n", numeric_columns=["AMOUNT"]).data
    return data.select(
        F.col("ID").cast("long").alias("ID"),
        F.col("`KODE UKER`").cast("long").alias("KODE_UKER"),
        "AMOUNT",
    )
