"""Queries for column names, filters, keys and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ORD, canonical_branch_code, canonical_id, col
from ..operators.columns import (
    MAIN_CODE,
    key_aliases,
    normalise_key,
    rename_alias,
    rename_reference,
    target_column,
)
from ..operators.diagnostics import key_sample, miss_report
from ..operators.filters import (
    dimension_condition,
    dimension_values,
    filter_dimension,
    filter_kw,
    filter_segment,
    fold_dimensions,
)
from ..operators.joins import JoinPolicy
from ..operators.lookup import (
    attach_branch,
    lookup_branch,
    unmapped_counts,
    unmapped_keys as keys_without_code,
)
from ..operators.mapping import (
    best_mapping as choose_mapping,
    candidate_overlap,
    id_mapping,
    lookup_id,
    mapping_candidates,
    pick_reference,
)
from ..operators.ordering import BRANCH_ORDER, sort_for_dashboard, with_position
from ..plans import FilterChoice, get_report
from ..plans.spec import resolve_filters
from . import inputs
from .register import registry

QUERIES, ORACLES, query = registry()

# -- names -----------------------------------------------------------------------------


@query("""
select s_suppkey as "KODE_UKER", s_name as "MAIN_BRANCH", s_acctbal as "OTHER" from supplier
""")
def alias_resolution(spark, d):
    """Columns found by alias, best alias first, whatever their case and padding."""
    s = inputs.table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("OTHER"),
        F.col("s_name").alias(" description "),
        F.col("s_nationkey").alias("UKER"),
        F.col("s_suppkey").alias("kode uker "),
    )
    named = rename_alias(s, key_aliases(), "KODE_UKER")
    named = rename_alias(named, ("MAIN_BRANCH", "DESCRIPTION"), "MAIN_BRANCH")
    return named.drop("UKER")


@query("""
select cast(s_suppkey as varchar) as "KODE_UKER", cast(s_nationkey as varchar) as "MAIN_CODE",
       s_name as "MAIN_BRANCH" from supplier
""")
def reference_rename(spark, d):
    """A unit table where one header could play several parts; each part gets its own."""
    s = inputs.table(spark, d, "supplier").select(
        F.lit("sub").alias("KODE SUB KANCA"),
        F.col("s_name").alias("SUB KANCA"),
        F.lit("other").alias("KODE KANCA"),
        F.col("s_suppkey").cast("string").alias("KANCA"),
        F.col("s_nationkey").cast("string").alias("KODE"),
    )
    return rename_reference(s).select("KODE_UKER", "MAIN_CODE", "MAIN_BRANCH")


@query("""
select cast(o_custkey as varchar) as "KODE_UKER", o_orderkey from orders
""")
def join_key_normalise(spark, d):
    """P5: the key as trimmed text under its own name."""
    o = inputs.table(spark, d, "orders")
    padded = F.concat(F.lit(f"\t{inputs.NBSP}"), F.col("o_custkey").cast("string"), F.lit(" "))
    return normalise_key(o.select(padded.alias("KODE UNIT"), "o_orderkey"))


@query("""
select c_custkey, c_acctbal as "SALDO", c_nationkey as "SALDO JUNI", c_custkey as "SALDO JULI",
       'SALDO JULI' as target, 'SALDO UPDATE' as target_without_months from customer
""")
def target_column_pick(spark, d):
    """The right-most month column takes the balance; plain SALDO never does."""
    c = inputs.table(spark, d, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("SALDO"),
        F.col("c_nationkey").alias("SALDO JUNI"),
        F.col("c_custkey").alias("SALDO JULI"),
    )
    return c.withColumns(
        {
            "target": F.lit(target_column(c.columns)),
            "target_without_months": F.lit(target_column(["NO REK", "SALDO", "SALDO XYZ"])),
        }
    )


# -- filters ---------------------------------------------------------------------------

_SEG = """(select c_custkey, c_nationkey, case when c_acctbal < 0 or c_acctbal > 9000 then ''
           else lower(c_mktsegment) end as seg from customer)"""


@query(f"select c_custkey from {_SEG} where seg in ('building', 'machinery')")
def filter_keep(spark, d):
    """A keep-list; case and padding do not matter, blank cells are not kept."""
    kept = filter_segment(inputs.segments(spark, d), include=["Building", " MACHINERY "])
    return kept.select("c_custkey")


@query(f"select c_custkey from {_SEG} where seg not in ('building', 'machinery')")
def filter_drop(spark, d):
    """A drop-list; blank and missing cells stay."""
    rows = inputs.segments(spark, d).withColumnRenamed("SEGMEN", "SOURCE")
    return filter_dimension(rows, ["SOURCE"], exclude=["building", "Machinery"]).select("c_custkey")


@query(f"select c_custkey from {_SEG} where seg = 'furniture'")
def filter_keep_and_drop(spark, d):
    """Both lists together."""
    rows = inputs.segments(spark, d)
    return filter_segment(rows, ["building", "FURNITURE", ""], ["Building"]).select("c_custkey")


@query(f"select c_custkey from {_SEG} where seg = 'household'")
def filter_alias_fallback(spark, d):
    """The filter finds its column under another header, and ignores absent ones."""
    rows = inputs.segments(spark, d).withColumnRenamed("SEGMEN", " group_product")
    return filter_segment(filter_kw(rows, ["Household"]), ["nothing"]).select("c_custkey")


_ORDER_FILTERS = """
select case when o_orderstatus = 'F' then 'default' end as run, count(*) as rows from orders where false group by 1
union all select 'default', count(*) from orders where o_orderstatus <> 'F' and o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW')
union all select 'kw off', count(*) from orders where o_orderstatus <> 'F'
union all select 'both off', count(*) from orders
union all select 'other kw', count(*) from orders where o_orderstatus <> 'F' and o_orderpriority = '5-LOW'
union all select 'keep without clearing', cast(0 as bigint)
"""


@query(_ORDER_FILTERS)
def filter_override(spark, d):
    """No choice is the default, an empty list is no filter, values replace."""
    spec = get_report("report-data-statis")
    runs = {
        "default": FilterChoice(),
        "kw off": FilterChoice(kw_keep=[]),
        "both off": FilterChoice(kw_keep=[], segment_drop=[]),
        "other kw": FilterChoice(kw_keep=["Kanwil Surabaya"]),
        "keep without clearing": FilterChoice(segment_keep=["korporasi"]),
    }
    return _count_runs(inputs.static_rows(spark, d), spec, runs)


@query("""
select 'keep only' as run, count(*) as rows from orders
where o_orderstatus = 'F' and o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW')
""")
def filter_keep_only(spark, d):
    """Keeping a value that is dropped by default also clears the drop-list."""
    runs = {"keep only": FilterChoice.keep_only(segment=["Korporasi"])}
    return _count_runs(inputs.static_rows(spark, d), get_report("report-data-statis"), runs)


def _count_runs(rows, spec, runs):
    """All runs in one pass over the rows: each run is a condition, counted side by side."""
    keep = {}
    for name, choice in runs.items():
        filters = resolve_filters(spec, choice)
        conditions = [
            dimension_condition(rows, "SEGMEN", filters.segment_keep, filters.segment_drop),
            dimension_condition(rows, "KW", filters.kw_keep),
        ]
        kept = F.lit(True)
        for c in conditions:
            kept = kept if c is None else kept & c
        keep[name] = kept
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in keep.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("run"), col(n).alias("rows")) for n in keep])
    return counts.select(F.inline(pairs))


@query(f"""
select c_custkey from {_SEG} where seg in ('automobile', 'household') and seg <> 'household'
""")
def filter_stored_dimension(spark, d):
    """P6 on a frame that stores the folded dimension: a plain IN on that column."""
    rows = fold_dimensions(inputs.segments(spark, d))
    return filter_segment(rows, ["AutoMobile", "household"], ["HOUSEHOLD"]).select("c_custkey")


@query("""
select 'EVENT' as dimension, upper(event_type) as value, count(*) as rows from events group by 2
union all
select 'SEGMENT', upper(c_mktsegment), count(*) from customer group by 2
""", name="dimension_values")
def dimension_values_report(spark, d):
    """What a dimension can hold, from the data."""
    events = inputs.table(spark, d, "events").select(F.concat(F.lit(" "), "event_type").alias("SOURCE"))
    segments = inputs.table(spark, d, "customer").select(F.lower("c_mktsegment").alias("SEGMEN"))
    tag = lambda df, name: df.select(F.lit(name).alias("dimension"), "value", "rows")
    return tag(dimension_values(events, ["SOURCE"]), "EVENT").unionByName(
        tag(dimension_values(segments, ["SEGMEN"]), "SEGMENT")
    )


# -- canonical keys --------------------------------------------------------------------


@query("""
select s_suppkey, case when s_nationkey < 6 then '00' || s_suppkey
       when s_nationkey < 18 then cast(s_suppkey as varchar) else s_suppkey || '.5' end as id
from supplier
""", name="canonical_id")
def canonical_id_form(spark, d):
    """trimmed, ``.0`` tails off, zero padding and fractions kept."""
    return _spelled(spark, d).select("s_suppkey", canonical_id(F.col("spelled")).alias("id"))


@query("""
select s_suppkey, case when s_nationkey < 18 then cast(s_suppkey as varchar) else s_suppkey || '.5' end as code
from supplier
""", name="canonical_branch_code")
def canonical_branch_code_form(spark, d):
    """the ordering form, zero padding off as well."""
    return _spelled(spark, d).select("s_suppkey", canonical_branch_code(F.col("spelled")).alias("code"))


def _spelled(spark, d):
    n, key = F.col("s_nationkey"), F.col("s_suppkey").cast("string")
    spelled = (
        F.when(n < 6, F.concat(F.lit(" 00"), key))
        .when(n < 12, F.concat(key, F.lit(".0")))
        .when(n < 18, F.concat(F.lit("\t"), key, F.lit(".000 ")))
        .otherwise(F.concat(key, F.lit(".5")))
    )
    return inputs.table(spark, d, "supplier").select("s_suppkey", spelled.alias("spelled"))


_LISTED = "[" + ", ".join(f"'{c}'" for c in BRANCH_ORDER) + "]"


@query(f"""
with coded as (select s_suppkey, case when s_acctbal < 0 then 'UNMAPPED' else cast(s_suppkey as varchar) end as code from supplier),
placed as (select *, coalesce(list_position({_LISTED}, code) - 1, {len(BRANCH_ORDER)}) as p from coded)
select s_suppkey, code as "MAIN_CODE", cast(p as integer) as position from placed
""")
def custom_order(spark, d):
    """O1, O2: dashboard order, unlisted codes after it in text order."""
    s = inputs.table(spark, d, "supplier")
    code = F.when(F.col("s_acctbal") < 0, F.lit("UNMAPPED")).otherwise(F.col("s_suppkey").cast("string"))
    rows = with_position(s.select("s_suppkey", code.alias("MAIN_CODE")), "MAIN_CODE")
    return sort_for_dashboard(rows, "MAIN_CODE", ["MAIN_CODE", "s_suppkey"])


# -- lookups ---------------------------------------------------------------------------

_CUSTOMER_LOOKUP = """
(select o.o_orderkey, cast(o.o_custkey as varchar) as key, cast(n.n_nationkey as varchar) as code, n.n_name as branch
 from orders o left join (select * from customer where c_acctbal >= 0) c on o.o_custkey = c.c_custkey
 left join nation n on c.c_nationkey = n.n_nationkey)
"""


def _orders_keyed(spark, d):
    o = inputs.table(spark, d, "orders")
    key = F.concat(F.lit(" "), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", key.alias("KODE UKER"), F.col("o_orderkey").alias(ORD))


@query(f"""
select o_orderkey, key as "KODE_UKER", coalesce(code, 'UNMAPPED') as "MAIN_CODE",
       coalesce(branch, 'UNMAPPED') as "MAIN_BRANCH" from {_CUSTOMER_LOOKUP}
""")
def lookup_left(spark, d):
    """Code and name per row, ``UNMAPPED`` where there is no hit."""
    return lookup_branch(_orders_keyed(spark, d), inputs.customer_reference(spark, d)).drop(ORD)


@query("""
with first as (select o_custkey, arg_min(o_orderstatus, o_orderkey) as code, arg_min(o_orderpriority, o_orderkey) as branch
               from orders group by 1)
select c_custkey, coalesce(code, 'UNMAPPED') as "MAIN_CODE", coalesce(branch, 'UNMAPPED') as "MAIN_BRANCH"
from customer left join first on c_custkey = o_custkey
""")
def lookup_first_hit(spark, d):
    """A reference with many rows per key; the first in row order counts."""
    reference = _order_reference(spark, d)
    raw = inputs.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("KODE_UKER"))
    return lookup_branch(raw, reference).drop("KODE_UKER")


def _order_reference(spark, d):
    return inputs.table(spark, d, "orders").select(
        F.col("o_custkey").alias("KODE_UKER"),
        F.col("o_orderstatus").alias("MAIN_CODE"),
        F.col("o_orderpriority").alias("MAIN_BRANCH"),
        F.col("o_orderkey").alias(ORD),
    )


@query("""
with first as (select o_custkey, arg_min(o_orderstatus, o_orderkey) as code, arg_min(o_orderpriority, o_orderkey) as branch
               from orders group by 1)
select event_id, coalesce(code, 'UNMAPPED') as "MAIN_CODE", coalesce(branch, 'UNMAPPED') as "MAIN_BRANCH"
from events left join first on user_id = o_custkey
""")
def lookup_large_reference(spark, d):
    """J1 with a reference over the broadcast bound: hot keys apart, the rest shuffled."""
    raw = inputs.table(spark, d, "events").select("event_id", F.col("user_id").alias("KODE_UKER"))
    policy = JoinPolicy(broadcast_bytes=-1, hot_share=0.01)
    return lookup_branch(raw, _order_reference(spark, d), policy=policy).drop("KODE_UKER")


@query(f"""
select count(code) as matched_rows, count(*) - count(code) as unmapped_rows from {_CUSTOMER_LOOKUP}
""")
def unmapped_audit(spark, d):
    """How many rows found a code."""
    return unmapped_counts(attach_branch(_orders_keyed(spark, d), inputs.customer_reference(spark, d)))


@query(f"""select distinct key as "KODE_UKER" from {_CUSTOMER_LOOKUP} where code is null""")
def unmapped_keys(spark, d):
    """The distinct keys without a code."""
    attached = attach_branch(_orders_keyed(spark, d), inputs.customer_reference(spark, d))
    return keys_without_code(attached)


@query(f"""
select 'good keys' as run, count(*) as total_rows, count(*) - count(code) as unmapped_rows,
       round((count(*) - count(code)) / count(*), 6) as unmapped_share, false as warn from {_CUSTOMER_LOOKUP}
union all
select 'broken keys', count(*), count(*), 1.0, true from orders
""")
def unmapped_diagnostic(spark, d):
    """An advisory when a lookup misses almost everything."""
    reference = inputs.customer_reference(spark, d)
    good = _orders_keyed(spark, d)
    broken = good.withColumn("KODE UKER", F.concat(F.lit("X"), F.trim("KODE UKER")))
    runs = {"good keys": good, "broken keys": broken}
    reports = [
        miss_report(attach_branch(rows, reference), MAIN_CODE).withColumn("run", F.lit(name))
        for name, rows in runs.items()
    ]
    return reports[0].unionByName(reports[1])


@query("""
select 'raw' as side, cast(row_number() over (order by o_orderkey) - 1 as integer) as position, cast(o_custkey as varchar) as key
from orders qualify position < 5
union all
select 'reference', cast(row_number() over (order by c_custkey) - 1 as integer) as position, cast(c_custkey as varchar)
from customer where c_acctbal >= 0 qualify position < 5
""")
def key_samples(spark, d):
    """The first five keys of each side, for the advisory."""
    orders = inputs.table(spark, d, "orders")
    raw = key_sample(orders, "o_custkey", order_by="o_orderkey").withColumn("side", F.lit("raw"))
    reference = key_sample(inputs.customer_reference(spark, d), "KANCA")
    return raw.unionByName(reference.withColumn("side", F.lit("reference")))


# -- choosing tables and mappings ------------------------------------------------------


@query("""
select 'UKER NEW' as picked, cast(s_suppkey as varchar) as "KODE_UKER", cast(s_nationkey as varchar) as "MAIN_CODE",
       s_name as "MAIN_BRANCH" from supplier
""")
def reference_table_pick(spark, d):
    """Of three tables, the one whose name and key header say it is the right one."""
    s = inputs.table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    ledger = s.select(key.alias("ACCOUNT NUMBER"), F.col("s_name").alias("DESCRIPTION"))
    units = s.select(
        key.alias("KODE SUB KANCA"), F.lit("wrong").alias("SUB KANCA"), key.alias("KANCA"), F.lit("wrong").alias("KODE")
    )
    new = s.select(
        key.alias("KODE UNIT"),
        F.lit("unit").alias("DESC UNIT"),
        F.col("s_nationkey").cast("string").alias("KODE KANCA"),
        F.col("s_name").alias("DESC KANCA"),
    )
    name, table = pick_reference([("Ledger", ledger), ("Unit Kerja", units), ("UKER NEW", new)])
    named = rename_reference(table).select("KODE_UKER", "MAIN_CODE", "MAIN_BRANCH")
    return named.withColumn("picked", F.lit(name))


def _probe(spark, d):
    ids = inputs.activity_source(spark, d).select(canonical_id(F.col("ID")).alias("ID"))
    return ids.distinct()


@query("""
select 'MASTER/ID USER/MAIN_CODE' as picked, cast(c_custkey as varchar) as "ID",
       cast(c_nationkey as varchar) as "MAIN_CODE" from customer where c_acctbal >= 0
""")
def best_mapping(spark, d):
    """The id column that knows the probe ids, not the one with the best name."""
    winner, mapping = choose_mapping([("MASTER", inputs.user_master(spark, d))], _probe(spark, d))
    return mapping.withColumn("picked", F.lit(winner.label))


@query("""
with u as (select distinct user_id from events),
     m as (select c_custkey from customer where c_acctbal >= 0)
select 'MASTER/ID USER/MAIN_CODE' as candidate, count(*) as overlap from m join u on c_custkey = user_id
union all
select * from (select 'MASTER/ID/MAIN_CODE', count(*) as n from m join u on c_custkey + 1000000 = user_id) where n > 0
""")
def mapping_overlap(spark, d):
    """How many distinct probe ids each candidate column pair knows."""
    found = mapping_candidates([("MASTER", inputs.user_master(spark, d))])
    counted = candidate_overlap(found, _probe(spark, d))
    names = F.array(*[F.lit(c.label) for c in found])
    return counted.select(F.get(names, "candidate").alias("candidate"), "overlap")


@query("""
select cast(user_id as varchar) as "ID", coalesce(cast(any_value(c_nationkey) as varchar), 'UNMAPPED') as "MAIN_CODE"
from events left join (select * from customer where c_acctbal >= 0) on user_id = c_custkey group by user_id
""")
def id_lookup(spark, d):
    """Master code per id."""
    winner = mapping_candidates([("MASTER", inputs.user_master(spark, d).drop("ID"))])[0]
    return lookup_id(_probe(spark, d), id_mapping(winner))

