"""Physical plans of the registered queries."""

import pytest

from checks.queries import QUERIES

def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_rollup_is_one_scan_with_partial_aggregation(spark, sf):
    text = plan(spark, sf, "health_rollup_24h")
    assert text.count("FileScan") == 1 and text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_columns_are_pruned(spark, sf):
    assert "html" not in plan(spark, sf, "clean_website")
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan(spark, sf, "brand_map_apply")
    assert "props" not in plan(spark, sf, "health_rollup_24h")


@pytest.mark.parametrize("name", ["feed_normalized", "catalog_enriched", "qa_issues", "clean_website", "cdx_captures", "failure_mode", "strip_html"])
def test_row_local_work_does_not_shuffle(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Exchange" not in text and text.count("FileScan") == 1


def test_website_steps_are_not_repeated(spark, sf):
    text = QUERIES["clean_website"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") <= 10 and text.count("url_decode") <= 4


def test_summary_is_one_scan(spark, sf):
    assert plan(spark, sf, "cluster_summary").count("FileScan") == 1


def test_vectors_are_encoded_once(spark, sf):
    assert plan(spark, sf, "embed_hash").count("ArrowEvalPython") == 1
