"""The stages one after another, the registered queries against their SQL, and plans."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import duck, rows_of
from sitemill.llm.oracles import ORACLES
from sitemill.llm.queries import QUERIES
from sitemill.session import materialize
from tests.llm.test_exact import brute as exact_groups
from tests.llm.test_neardup import brute as near_groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append((name, docs))
        docs = materialize(stage(spark, docs, sf), "stage")
    tables = [d for _, d in seen] + [docs]
    given, told, exact, near, mixed, tokens = tables
    assert all(t.columns == given.columns for t in tables[:-1])
    texts = lambda t: [(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()]
    assert told.count() >= 0.97 * given.count() and told.exceptAll(given).isEmpty()
    assert exact.count() == exact_groups(texts(told))[1] and exact.exceptAll(told).isEmpty()
    assert {d for d, _ in texts(exact)} == {k for _, k, _, _ in exact_groups(texts(told))[0]}
    assert {d for d, _ in texts(near)} == {c for _, _, c in near_groups(texts(exact), corpus_pipeline.PERCENT)[0]}
    assert mixed.distinct().exceptAll(near).isEmpty()
    assert tokens.count() == mixed.count() and tokens.where("not round_trip").isEmpty()
    assert corpus_pipeline.run(spark, sf).exceptAll(tokens).isEmpty()


def test_empty_and_odd_tables(spark, odd, empty, sf):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "stage")
        docs.count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cur = duck(sf).execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and want[1]


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op9_secrets", "op10_mixing"])
def test_native_plans(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_other_queries_return_every_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_langid", "op5_bpe", "op6_token_files", "op7_quality", "op8_toxicity"):
        got = QUERIES[name](spark, sf)
        assert got.agg(F.count("*"), F.countDistinct("doc_id")).first() == (n, n), name


def test_library_does_without_the_package(tmp_path):
    """The entry imports when the package and the pipeline are not there."""
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("sitemill.llm"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {repo!r})
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=60)
