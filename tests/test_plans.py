"""What the physical plans of all queries must not contain, and what they push down."""

from __future__ import annotations

import pytest

from branchtally.driver import QUERIES, inputs
from branchtally.plans import get_report, run_report

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Window ")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not [bad for bad in FORBIDDEN if bad in text]


def test_summary_reads_only_the_columns_it_needs(spark):
    raw, ref = inputs.volume_rows(spark, SF_DIR), inputs.supplier_reference(spark, SF_DIR)
    text = plan(run_report(get_report("akumulasi"), raw, ref).summary)
    reads = {s.split(">")[0] for s in text.split("ReadSchema: struct<")[1:] if "l_suppkey" in s.split(">")[0]}
    assert reads == {"l_suppkey:bigint,l_quantity:double,l_extendedprice:double"}


def test_large_reference_does_not_move_raw_rows_of_a_summary(spark):
    """Rows are aggregated per key before the lookup, so the join sits above an aggregate."""
    raw, ref = inputs.volume_rows(spark, SF_DIR), inputs.supplier_reference(spark, SF_DIR)
    text = plan(run_report(get_report("akumulasi"), raw, ref).branches)
    lines = text.split("\n")
    depth = {k: next(i for i, l in enumerate(lines) if k in l) for k in ("Join ", "l_suppkey")}
    between = "\n".join(lines[depth["Join "] : depth["l_suppkey"] + 1])
    assert "HashAggregate" in between
