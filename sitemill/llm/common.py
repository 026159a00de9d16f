"""Shared helpers: tables, written intermediates, joins that survive hot keys, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.session import materialize, tune

#: Characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of one Arrow batch: texts can be long, Python workers are small.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the package: those of the library, and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(id_column: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo 4; remainder 2 is held out from all training."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``row`` (unique), ``run`` (the writing partition) and the document as a struct, written.

    The struct keeps the documents' own column names apart from those of the operators.
    Numbers are read back from the written table, so a lost executor cannot change them.
    """
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), F.struct("*").alias("doc")),
        name,
    )


def attach(rows: DataFrame, key: list[str], facts: DataFrame) -> DataFrame:
    """Inner join of ``rows`` (with their ``run``) and ``facts`` (unique by ``key``).

    The facts are first joined with the distinct keys of each run and then with its rows, so a
    key that a third of all rows share is spread over as many join keys as there are runs.
    """
    per_run = rows.select("run", *key).distinct()
    return rows.join(per_run.join(facts, key), ["run", *key])


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` (smallest reachable node) of the nodes on ``edges(a, b)``.

    Labels take the smallest label next to them and then their label's label, until no label
    changes. Rows per round: nodes plus twice the links. Each round is a written table.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    before = None
    while True:
        labels = materialize(labels, f"{name}-labels")
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:  # labels only ever fall
            return labels
        before = total
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        labels = low.join(up, "low", "left").select("node", F.least("low", "up").alias("component"))


def per_worker(key: str, build: Callable[[], object]) -> object:
    """``build()``, once per Python worker process rather than once per task."""
    kept = sys.modules.setdefault("_sitemill_worker", types.ModuleType("_sitemill_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def travel(module: str) -> None:
    """Code of ``module`` travels with its tasks: workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travel(__name__)
