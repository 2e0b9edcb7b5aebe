"""The seven reports over the given tables, as a user would run them."""

from __future__ import annotations


from ..plans import FilterChoice, get_report, run_report
from . import inputs
from .amounts import _CROSSTAB_ROWS, _SUMS, _UPDATED, money, place, whole
from .register import registry

QUERIES, ORACLES, query = registry()


@query(f"""
select {place('code')} as position, 'branch' as row_kind, code as "MAIN_CODE", branch as "MAIN_BRANCH",
       {whole('fbi')} as "Sum of FBI", {whole('volume')} as "VOLUME_IN_IDR" from {_SUMS}
union all
select 26, 'total', 'Grand Total', null, {whole(money('fbi'))}, {whole(money('volume'))} from {_SUMS}
""")
def report_accumulated(spark, d):
    """Two sums per branch after the lookup, unmapped rows in a row of their own."""
    raw, reference = inputs.volume_rows(spark, d), inputs.supplier_reference(spark, d)
    return run_report(get_report("akumulasi"), raw, reference).summary


@query(_CROSSTAB_ROWS)
def report_active_users(spark, d):
    """R2: active and inactive users per master branch."""
    return run_report(
        get_report("timeseries-active-user-qlola"),
        inputs.activity_source(spark, d),
        inputs.event_reference(spark, d),
        [("MASTER", inputs.user_master(spark, d))],
    ).summary


def _with_total(source: str, code: str, branch: str, value: str, mode: str = "round") -> str:
    rows = f"select {place('code')} as position, 'branch' as row_kind, code as \"{code}\", branch as \"{branch}\""
    total = "select 26, 'total', 'Grand Total', null"
    if mode == "count":
        return f'{rows}, v as "{value}" from {source} union all {total}, cast(sum(v) as bigint) from {source}'
    return (
        f'{rows}, {whole("v", mode)} as "{value}" from {source} '
        f"union all {total}, {whole(money('v'), mode)} from {source}"
    )


_ORDER_BRANCH = """
(select o.*, coalesce(cast(n.n_nationkey as varchar), 'UNMAPPED') as code, coalesce(n.n_name, 'UNMAPPED') as branch
 from orders o left join (select * from customer where c_acctbal >= 0) c on o.o_custkey = c.c_custkey
 left join nation n on c.c_nationkey = n.n_nationkey)
"""


@query(
    _with_total(
        f"""(select code, branch, count(*) filter (where year(o_orderdate) <> 2000) as v from {_ORDER_BRANCH}
            where o_orderstatus <> 'F' and o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1, 2)""",
        "MAIN_CODE",
        "MAIN_BRANCH",
        "Count of ID_PRODUCT",
        "count",
    )
)
def report_static_count(spark, d):
    """Products per branch of one region, without corporate rows."""
    raw, reference = inputs.static_rows(spark, d), inputs.customer_reference(spark, d)
    return run_report(get_report("report-data-statis"), raw, [("UKER", reference)]).summary


@query(
    _with_total(
        f"""(select cast(l_suppkey as varchar) as code, 'Branch ' || l_suppkey as branch, {money('l_extendedprice')} as v
            from lineitem where l_returnflag <> 'R' group by 1, 2)""",
        "MAINBR",
        "MBDESC",
        "AMOUNT_IN_IDR",
    )
)
def report_trade_volume(spark, d):
    """Amounts per branch without the wholesale segment; blank segments count."""
    return run_report(get_report("rincian-vol-tf"), inputs.trade_rows(spark, d)).summary


@query(
    _with_total(
        f"""(select cast(o_custkey as varchar) as code, 'Branch ' || o_custkey as branch, {money('o_totalprice')} as v
            from orders group by 1, 2)""",
        "MAINBR",
        "MBNAME",
        "AMOUNT_IN_IDR",
    )
)
def report_guarantee(spark, d):
    """Amounts per branch; a filter choice has no effect on this report."""
    choice = FilterChoice(segment_keep=["ignored"], source_drop=["ignored"])
    return run_report(get_report("rincian-portal-bg"), inputs.guarantee_rows(spark, d), choice=choice).summary


@query(
    _with_total(
        f"""(select code, branch, {money('o_totalprice / 4')} as v from {_ORDER_BRANCH}
            where o_orderstatus <> 'P' group by 1, 2)""",
        "MAIN_CODE",
        "MAIN_BRANCH",
        "Sum of VOLUME_IDR",
        "ceil",
    )
)
def report_va_volume(spark, d):
    """One segment's volume per branch, rounded up."""
    raw, reference = inputs.account_rows(spark, d), inputs.customer_reference(spark, d)
    return run_report(get_report("timeseries-fbi-briva"), raw, reference).summary


@query(_UPDATED)
def report_balance_update(spark, d):
    """The register with this month's balances."""
    run = run_report(
        get_report("report-giro"), inputs.monthly(spark, d), master=inputs.register(spark, d)
    )
    return run.summary
