"""The registered queries: SQL where there is some, odd and empty tables, the pipeline."""

from __future__ import annotations

import pytest

import corpus_pipeline
from branchtally.llm import bpe, infill, licenses, mixing, ngram_join, pieces, pii, quality, secrets, sharding, toxicity
from branchtally.llm.catalog import ORACLES, QUERIES
from tests.oracle import connect, difference

from .conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


RUNS = {
    "toxicity": lambda d, labels: toxicity.assess(d, labels),
    "pii": lambda d, labels: pii.report(pii.scan(d)),
    "bpe": lambda d, labels: bpe.digests(d),
    "infill": lambda d, labels: infill.digests(d),
    "pieces": lambda d, labels: pieces.digests(d),
    "mixing": lambda d, labels: mixing.mix(d),
    "ngram": lambda d, labels: ngram_join.groups(d),
    "licenses": lambda d, labels: licenses.scan(d),
    "sharding": lambda d, labels: sharding.shard_rows(d),
    "secrets": lambda d, labels: secrets.report(secrets.scan(d, secrets.train(d))),
    "quality": lambda d, labels: quality.assess(d, labels),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_empty_tables(odd_docs, empty_docs, labels, name):
    out = RUNS[name](odd_docs, labels).collect()
    assert out if name == "mixing" else len(out) == odd_docs.count()
    assert RUNS[name](empty_docs, labels).collect() == []
    assert RUNS[name](odd_docs, labels.where("1 = 0")).collect() if name in ("toxicity", "quality") else True


@pytest.mark.parametrize("name", ["op2_pii", "op5_mixing", "op9_secrets", "op10_quality"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("EvalPython", "InPandas", "InArrow", "CartesianProduct") if bad in plan]


def test_pipeline_keeps_its_promises(spark, documents):
    docs, ids = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            ids.append((name, {r[0] for r in docs.collect()}))
    kept = dict(ids)
    assert kept["near_copies"] < kept["toxicity"] and kept["secrets"] == kept["near_copies"] and kept["mixing"] < kept["secrets"]
    assert not docs.where("text rlike 'token = \"[0-9a-f]{24}'").count()
    assert out.count() == docs.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 50
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_take_odd_rows(spark, odd_docs, empty_docs):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.select(plain), SF_DIR).count() > 0
        assert stage(spark, empty_docs.select(plain), SF_DIR).count() == 0
