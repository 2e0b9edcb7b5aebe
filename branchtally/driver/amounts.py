"""Queries for sums, counts, totals, activity per user and balance write-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import whole_units
from ..operators.activity import (
    ACTIVE,
    CONTEXT_CODE,
    INACTIVE,
    activity_category,
    activity_crosstab as crosstab,
    crosstab_report,
    only_mapped,
    roll_up_ids,
    roll_up_pairs,
)
from ..operators.filters import filter_segment, filter_source
from ..operators.lookup import lookup_branch
from ..operators.ordering import BRANCH_ORDER, UNLISTED
from ..operators.reconcile import monthly_balances, pick_balances, write_back
from ..operators.summarize import headline, report_rows, summarize, with_grand_total
from ..plans import FilterChoice, get_report, run_report
from ..plans.reports import activity_rows, detail_rows
from . import inputs
from .register import registry

QUERIES, ORACLES, query = registry()


def money(expression: str) -> str:
    """SQL: exact sum rounded half-even to two decimals, as double."""
    return f"cast(round_even(sum(cast({expression} as decimal(28,8))), 2) as double)"


_BRANCHED = """
(select l.*, coalesce(cast(n.n_nationkey as varchar), 'UNMAPPED') as code, coalesce(n.n_name, 'UNMAPPED') as branch
 from lineitem l left join (select * from supplier where s_acctbal >= 0) s on l.l_suppkey = s.s_suppkey
 left join nation n on s.s_nationkey = n.n_nationkey)
"""

_SUMS = f"""
(select code, branch, {money('l_quantity')} as fbi, {money('l_extendedprice')} as volume
 from {_BRANCHED} group by 1, 2)
"""


def _branched(spark, d):
    return lookup_branch(inputs.volume_rows(spark, d), inputs.supplier_reference(spark, d))


# -- sums and counts -------------------------------------------------------------------


@query(f'select code as "MAIN_CODE", branch as "MAIN_BRANCH", volume as "VOLUME_IN_IDR" from {_SUMS}')
def pivot_sum(spark, d):
    """A1, A5: one exact sum per branch, in two decimals."""
    return summarize(_branched(spark, d))


@query(f"""
select code as "MAIN_CODE", branch as "MAIN_BRANCH",
       cast(round_even(sum(cast(l_extendedprice / 3 as decimal(38,12))), 2) as double) as "VOLUME_IN_IDR"
from {_BRANCHED} group by 1, 2
""")
def pivot_sum_fractions(spark, d):
    """A1: values with more digits than money has; the digits beyond six decimals count too."""
    thirds = F.col("VOLUME_IN_IDR").cast("double") / 3
    return summarize(_branched(spark, d).withColumn("VOLUME_IN_IDR", thirds))


@query(f'select code as "MAIN_CODE", branch as "MAIN_BRANCH", fbi as "FBI", volume as "VOLUME_IN_IDR" from {_SUMS}')
def pivot_multi_sum(spark, d):
    """A2: several value columns in one pass."""
    return summarize(_branched(spark, d), value_columns=("FBI", "VOLUME_IN_IDR"))


_PART_NAME = "case when p_type = 'SMALL' then '  ' when p_type = 'PROMO' then null else p_name end"


def _parts(spark, d):
    kind = F.col("p_type")
    name = F.when(kind == "SMALL", F.lit(f" {inputs.NBSP}")).when(kind != "PROMO", F.col("p_name"))
    return inputs.table(spark, d, "part").select("p_brand", kind.alias("p_type"), "p_size", name.alias("ID_PRODUCT"))


@query(f"""
select p_brand, p_type, count(*) filter (where trim({_PART_NAME}) <> '') as "ID_PRODUCT" from part group by 1, 2
""")
def pivot_count_nonblank(spark, d):
    """A3: cells that are not blank; repeats count, and so do groups with none."""
    return summarize(_parts(spark, d), ("p_brand", "p_type"), ("ID_PRODUCT",), "count")


@query(f"""
select case when p_size < 10 then null when p_size < 20 then '' else p_brand end as grp,
       {money('p_retailprice')} as p_retailprice from part group by 1
""")
def group_null_key(spark, d):
    """A4: missing and blank group values are groups of their own."""
    size = F.col("p_size")
    grp = F.when(size < 20, F.when(size >= 10, F.lit(""))).otherwise(F.col("p_brand"))
    rows = inputs.table(spark, d, "part").select(grp.alias("grp"), "p_retailprice")
    return summarize(rows, ("grp",), ("p_retailprice",))


@query(f"""
select 'branch' as row_kind, code as "MAIN_CODE", branch as "MAIN_BRANCH", fbi as "FBI", volume as "VOLUME_IN_IDR" from {_SUMS}
union all
select 'total', null, null, {money('fbi')}, {money('volume')} from {_SUMS}
""")
def grand_total(spark, d):
    """One total row over the rounded branch rows, no subtotals."""
    values = ("FBI", "VOLUME_IN_IDR")
    sums = summarize(_branched(spark, d), value_columns=values)
    return with_grand_total(sums, ("MAIN_CODE", "MAIN_BRANCH"), values)


@query(f"select {money('volume')} as total_value, count(*) as branch_count from {_SUMS}")
def headline_metrics(spark, d):
    """The total of the primary column and the number of branches."""
    return headline(summarize(_branched(spark, d)), "VOLUME_IN_IDR")


def place(code: str) -> str:
    """SQL: dashboard position of a code."""
    listed = "[" + ", ".join(f"'{c}'" for c in BRANCH_ORDER) + "]"
    return f"cast(coalesce(list_position({listed}, {code}) - 1, {UNLISTED}) as integer)"


def whole(expression: str, mode: str = "round") -> str:
    return f"cast({'ceil' if mode == 'ceil' else 'round_even'}({expression}{'' if mode == 'ceil' else ', 0'}) as bigint)"


@query(f"""
select {place('code')} as position, 'branch' as row_kind, code as "MAIN_CODE", branch as "MAIN_BRANCH",
       {whole('fbi')} as "Sum of FBI", {whole('volume')} as "VOLUME_IN_IDR" from {_SUMS}
union all
select 26, 'total', 'Grand Total', null, {whole(money('fbi'))}, {whole(money('volume'))} from {_SUMS}
""")
def summary_table(spark, d):
    """K1, K3: the summary as reported, under its display names."""
    groups, values = ("MAIN_CODE", "MAIN_BRANCH"), ("FBI", "VOLUME_IN_IDR")
    sums = summarize(_branched(spark, d), groups, values)
    return report_rows(sums, groups, values, display={"FBI": "Sum of FBI"})


@query(f"""
select {place('code')} as position, 'branch' as row_kind, code as "MAIN_CODE", branch as "MAIN_BRANCH",
       {whole('volume')} as "VOLUME_IN_IDR" from {_SUMS}
union all
select 26, 'total', 'Grand Total', null, {whole(money('volume'))} from {_SUMS}
""")
def summary_control_chars(spark, d):
    """K7: control characters in group columns do not reach the summary."""
    groups, values = ("MAIN_CODE", "MAIN_BRANCH"), ("VOLUME_IN_IDR",)
    noisy = F.concat(F.lit("\x07"), "MAIN_BRANCH", F.lit("\x00\x1f"))
    sums = summarize(_branched(spark, d).withColumn("MAIN_BRANCH", noisy), groups, values)
    return report_rows(sums, groups, values)


@query("""
select o_orderkey, cast(o_custkey as varchar) as "KODE_UKER", o_orderpriority as note,
       cast(round_even(o_totalprice, 0) as bigint) as "VOLUME_IN_IDR",
       case when o_orderstatus = 'F' then null else o_totalprice end as rate
from orders
""")
def detail_table(spark, d):
    """K2, K8: every row; value columns whole, NaN empty, control characters gone."""
    rows = inputs.table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("KODE_UKER"),
        F.concat(F.lit("\x00"), "o_orderpriority", F.lit("\x1b")).alias("note"),
        F.col("o_totalprice").alias("VOLUME_IN_IDR"),
        F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("rate"),
        F.col("o_orderkey").alias("_ord"),
    )
    return detail_rows(rows, ("VOLUME_IN_IDR",))


@query("""
select l_orderkey, l_linenumber, l_suppkey, cast(round_even(l_quantity / 2 - 3, 0) as bigint) as units from lineitem
""")
def round_half_even(spark, d):
    """Halves go to the even neighbour, below zero too."""
    half = F.col("l_quantity") / 2 - 3
    rows = inputs.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", whole_units(half).alias("units"))


@query("""
select l_orderkey, l_linenumber, l_suppkey, cast(ceil(l_extendedprice / 8 - 500) as bigint) as units from lineitem
""")
def round_ceil(spark, d):
    """Every fraction goes up."""
    price = F.col("l_extendedprice") / 8 - 500
    rows = inputs.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", whole_units(price, "ceil").alias("units"))


@query("""
select cast(26 as integer) as position, 'total' as row_kind, 'Grand Total' as "MAIN_CODE", cast(null as varchar) as "MAIN_BRANCH",
       cast(count(*) as bigint) as "VOLUME_IN_IDR" from lineitem where l_returnflag = 'no such segment'
""")
def empty_summary(spark, d):
    """A filter that leaves nothing gives an empty table and a total of 0."""
    rows = filter_segment(_branched(spark, d), include=["no such segment"])
    groups = ("MAIN_CODE", "MAIN_BRANCH")
    return report_rows(summarize(rows), groups, ("VOLUME_IN_IDR",))


@query(f"""
select count(*) as processed_rows, count(*) filter (where l_returnflag = 'A' and l_linestatus <> 'F') as kept_rows,
       count(*) filter (where l_returnflag = 'A' and l_linestatus <> 'F' and code = 'UNMAPPED') as unmapped_rows,
       {money("case when l_returnflag = 'A' and l_linestatus <> 'F' then l_extendedprice else 0 end")} as total_value,
       count(distinct case when l_returnflag = 'A' and l_linestatus <> 'F' then code end) as branch_count
from {_BRANCHED}
""")
def record_counts(spark, d):
    """Rows read, rows kept by the filters, rows without a branch."""
    choice = FilterChoice(segment_keep=["a"], source_drop=["f"])
    run = run_report(
        get_report("akumulasi"), inputs.volume_rows(spark, d), inputs.supplier_reference(spark, d), choice=choice
    )
    return run.metrics


@query("""
select 0 as line, 'Financial Summary Report' as item, '' as value
union all
select 2, 'Total Records Processed:', format('{:,}', count(*)) from lineitem where l_returnflag in ('A', 'N') and l_linestatus <> 'F'
union all
select 3, 'Filter Applied:', 'A, N (only); F (SOURCE excluded)'
""")
def run_metadata(spark, d):
    """The head of a report; the time stamp line is left out of the comparison."""
    choice = FilterChoice(segment_keep=["A", "N"], source_drop=["F"])
    run = run_report(
        get_report("akumulasi"), inputs.volume_rows(spark, d), inputs.supplier_reference(spark, d), choice=choice
    )
    return run.metadata.where(F.col("line") != 1)


# -- activity --------------------------------------------------------------------------

_PER_ID = """
(select cast(user_id as varchar) as id, cast(count(*) filter (where value >= 120) as double) as n,
        upper(substr(arg_min(event_type, event_id), 1, 2)) as context
 from events where event_type <> 'error' group by user_id)
"""
_CODED = f"""
(select p.*, coalesce(cast(c.c_nationkey as varchar), 'UNMAPPED') as code,
        case when n >= 5 then '{ACTIVE}' else '{INACTIVE}' end as category
 from {_PER_ID} p left join (select * from customer where c_acctbal >= 0) c on p.id = cast(c.c_custkey as varchar))
"""
_CROSSTAB = f"""
(select code, count(*) filter (where category = '{ACTIVE}') as a, count(*) filter (where category = '{INACTIVE}') as i
 from {_CODED} where code <> 'UNMAPPED' group by 1)
"""


def _kept(spark, d):
    return filter_source(inputs.activity_source(spark, d), exclude=["CMS"])


def _per_id(spark, d):
    pairs = roll_up_pairs(_kept(spark, d), "KODE_UKER")
    coded = lookup_branch(pairs, inputs.event_reference(spark, d))
    return roll_up_ids(coded.withColumnRenamed("MAIN_CODE", CONTEXT_CODE), CONTEXT_CODE)


def _activity(spark, d):
    masters = [("MASTER", inputs.user_master(spark, d))]
    return activity_rows(_kept(spark, d), inputs.event_reference(spark, d), masters)


@query(f'select id as "ID", n as "FREKUENSI", context as "UKER_MAIN_CODE" from {_PER_ID}')
def per_id_rollup(spark, d):
    """Per id, the summed frequency and the first row's context code."""
    return _per_id(spark, d)


@query(f"""
select id as "ID", case when n >= 5 then '{ACTIVE}' else '{INACTIVE}' end as "USER_AKTIF" from {_PER_ID}
""")
def threshold_category(spark, d):
    """Active from five on."""
    return _per_id(spark, d).select("ID", activity_category(F.col("FREKUENSI")).alias("USER_AKTIF"))


@query("""
select c_custkey, cast(c_nationkey as varchar) as "MAIN_CODE" from customer
where c_acctbal >= 0 and c_mktsegment not in ('BUILDING', 'MACHINERY', 'FURNITURE')
""")
def mapped_only(spark, d):
    """Rows that belong to no branch are left out of summaries."""
    seg = F.col("c_mktsegment")
    code = (
        F.when(F.col("c_acctbal") < 0, F.lit("UNMAPPED"))
        .when(seg == "BUILDING", F.lit(""))
        .when(seg == "MACHINERY", F.lit("#N/A"))
        .when(seg != "FURNITURE", F.col("c_nationkey").cast("string"))
    )
    return only_mapped(inputs.table(spark, d, "customer").select("c_custkey", code.alias("MAIN_CODE")))


@query(f"""
select id as "ID", context as "UKER_MAIN_CODE", code as "MAIN_CODE", n as "FREKUENSI", category as "USER_AKTIF" from {_CODED}
""")
def activity_detail(spark, d):
    """P20: one row per id in the five detail columns; unmapped ids stay."""
    return _activity(spark, d)


@query(f'select code as "MAIN_CODE", a as "{ACTIVE}", i as "{INACTIVE}" from {_CROSSTAB}')
def activity_crosstab(spark, d):
    """Ids per branch and category, zero where there are none."""
    return crosstab(_activity(spark, d))


_CROSSTAB_ROWS = f"""
select {place('code')} as position, 'branch' as row_kind, code as "MAIN_CODE", a as "{ACTIVE}", i as "{INACTIVE}",
       a + i as "Grand Total" from {_CROSSTAB}
union all
select 26, 'total', 'Grand Total', cast(sum(a) as bigint), cast(sum(i) as bigint), cast(sum(a + i) as bigint) from {_CROSSTAB}
"""


@query(_CROSSTAB_ROWS)
def crosstab_margins(spark, d):
    """Row totals, column totals and the corner."""
    return crosstab_report(crosstab(_activity(spark, d)))


# -- balances --------------------------------------------------------------------------

_BALANCES = """
(select o_custkey, arg_min(o_totalprice, o_orderkey) as balance from orders
 where o_orderpriority <> '1-URGENT' and o_orderstatus <> 'F' group by 1)
"""


@query(f'select cast(o_custkey as varchar) as account, balance from {_BALANCES}')
def balance_first_numeric_hit(spark, d):
    """The first balance that is a number; one with commas is none."""
    _, monthly = pick_balances(
        [("notes", inputs.table(spark, d, "nation")), ("balances", inputs.monthly(spark, d))]
    )
    return monthly_balances(monthly)


_REGISTER = f"""
(select c.*, b.balance, c_nationkey = 0 as is_blank, c_mktsegment = 'HOUSEHOLD' as is_skipped
 from customer c left join {_BALANCES} b on c.c_custkey = b.o_custkey)
"""
_UPDATED = f"""
select case when is_blank then ' ' else cast(c_custkey as varchar) end as "NO REK",
       case when is_skipped then ' DEPOSITO ' else 'Giro' end as "JENIS", c_acctbal as "SALDO",
       case when is_blank or is_skipped or balance is null then c_custkey
            else cast(round_even(balance, 0) as bigint) end as "SALDO UPDATE",
       c_custkey as "ROW_NO"
from {_REGISTER}
"""


@query(_UPDATED)
def balance_update(spark, d):
    """Matched rows take the balance, all others keep what they had."""
    return write_back(inputs.register(spark, d), inputs.monthly(spark, d)).register


@query(f"""
select count(*) filter (where not is_blank) as scanned_rows,
       count(*) filter (where not is_blank and not is_skipped and balance is null) as unmatched_rows,
       count(*) filter (where not is_blank and not is_skipped and balance is not null) as updated_rows
from {_REGISTER}
""")
def balance_update_counts(spark, d):
    """Rows looked at, rows without a balance, rows updated."""
    return write_back(inputs.register(spark, d), inputs.monthly(spark, d)).counts()
