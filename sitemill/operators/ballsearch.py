"""Exact nearest-neighbour search that scores a part of the points.

Points lie in balls. A ball's middle and radius bound the score that any of its points can have
for a query: ``q·p <= q·c + |q| r`` for dot and cosine, ``|q - p| >= |q - c| - r`` for distance. A first
round scores each query's most promising balls; the k-th score found there tells which other balls can
still hold a hit, and a second round scores those. The rows are those of ``vectors.search``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.operators.cluster import balls
from sitemill.operators.vectors import DEFAULT_K, QUERY_BYTES, _best, _scores, check_dimension, metric_name, top_k
from sitemill.session import materialize

#: Bounds have room for rounding.
ROOM = 1e-9


@dataclass(frozen=True)
class Index:
    """Where the points lie by ball, and the metric."""

    path: str
    metric: str
    #: Scored and possible pairs of the last search, for reports.
    seen: list


def build(points: DataFrame, path: str, metric: str = "Cosine", block_points: int | None = None) -> Index:
    """Writes ``id, vector`` points by ball, and a row per ball. Vectors are scaled to unit length for cosine."""
    metric = metric_name(metric)
    spark = points.sparkSession
    rows = points.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    if metric == "Cosine":
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("_n", norm).withColumn("vector", F.transform("vector", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))).drop("_n")
    placed = balls(rows, block_points)
    placed.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/points")
    placed = spark.read.parquet(f"{path}/points")

    def ball(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(rows["vector"].to_list()).astype(np.float64)
        center = matrix.mean(0)
        return pd.DataFrame([(key[0], center, np.sqrt(((matrix - center) ** 2).sum(1)).max(), len(rows))], columns=["block", "center", "radius", "n"])

    facts = placed.groupBy("block").applyInPandas(ball, "block long, center array<double>, radius double, n long")
    facts.write.mode("overwrite").parquet(f"{path}/balls")
    return Index(path, metric, [])


def _bounds(queries: np.ndarray, centers: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The greatest ``near`` (score, or negated distance) that a point of each ball can have for each query."""
    if metric == "Euclid":
        away = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (centers**2).sum(1)[None] - 2 * queries @ centers.T, 0))
        return np.minimum(radius - away, 0) + ROOM * (1 + away)
    reach = np.linalg.norm(queries, axis=1)[:, None] * radius
    return queries @ centers.T + reach + ROOM * (1 + reach)


def _round(placed: DataFrame, asked: dict[int, np.ndarray], qids: np.ndarray, queries: np.ndarray, k: int, metric: str, floor: float | None, schema: str) -> DataFrame:
    """The best ``k`` of each query among the balls that are asked for it, as far as each task knows."""
    sent = placed.sparkSession.sparkContext.broadcast((asked, qids, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, qids, queries = sent.value
        best = None
        for batch in batches:
            for block, rows in batch.groupby("block"):
                which = asked.get(int(block))
                if which is None:
                    continue
                near = _scores(queries[which], np.stack(rows["vector"].to_list()).astype(np.float64), "Dot" if metric == "Cosine" else metric)
                least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else -np.inf
                q, p = np.nonzero((near >= least) & (near >= (-np.inf if floor is None else floor)))
                new = pd.DataFrame({"q": which[q], "id": rows["id"].to_numpy(dtype=object)[p], "near": near[q, p]})
                best = _best(new if best is None else pd.concat([best, new]), k)
        if best is not None and len(best):
            yield pd.DataFrame({"query_id": qids[best["q"]], "id": best["id"], "near": best["near"]})

    blocks = sorted(asked)
    some = placed.where(F.col("block").isin(blocks)) if len(blocks) <= 1000 else placed.where(F.col("block").between(blocks[0], blocks[-1]))
    return some.select("block", "id", "vector").mapInPandas(run, schema)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = DEFAULT_K, threshold: float | None = None) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` nearest points; see ``vectors.search``.

    Queries are as many as are sent to every task (``QUERY_BYTES``); cut larger sets into several calls.
    """
    metric = index.metric
    queries = materialize(queries.select("query_id", "vector"), "queries")
    dims, count = queries.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    placed = spark.read.parquet(f"{index.path}/points")
    id_type, qid_type = placed.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    if not count:
        return spark.createDataFrame([], f"query_id {qid_type}, id {id_type}, score double, rank int")
    if count * dims * 8 > QUERY_BYTES:
        raise ValueError(f"{count} queries are more than {QUERY_BYTES} bytes: search in parts")
    facts = spark.read.parquet(f"{index.path}/balls").orderBy("block").toPandas()  # a row per ball
    schema = f"query_id {qid_type}, id {id_type}, near double"
    if not len(facts):
        return spark.createDataFrame([], f"query_id {qid_type}, id {id_type}, score double, rank int")
    rows = check_dimension(queries, len(facts["center"].iloc[0])).collect()
    qids = np.array([r["query_id"] for r in rows], dtype=object)
    matrix = np.array([r["vector"] for r in rows], np.float64)
    if metric == "Cosine":
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1, norms)
    floor = None if threshold is None else (-threshold if metric == "Euclid" else threshold)
    blocks, sizes = facts["block"].to_numpy(), facts["n"].to_numpy()
    bounds = _bounds(matrix, np.stack(facts["center"].to_list()), facts["radius"].to_numpy(), metric)
    possible = bounds >= (-np.inf if floor is None else floor - ROOM)

    def asked(chosen: np.ndarray) -> dict[int, np.ndarray]:
        return {int(blocks[b]): np.flatnonzero(chosen[:, b]) for b in np.flatnonzero(chosen.any(axis=0))}

    # The most promising balls of each query, until they hold k points.
    order = np.argsort(-bounds, axis=1)
    held = np.cumsum(sizes[order], axis=1)
    first = np.zeros_like(possible)
    np.put_along_axis(first, order, (held - sizes[order]) < k, axis=1)
    first &= possible
    found = materialize(_round(placed, asked(first), qids, matrix, k, metric, floor, schema), "first-hits")
    ranked = top_k(found, "query_id", [F.desc("near"), F.col("id")], k)
    least = {r["query_id"]: r["near"] for r in ranked.where(F.col("rank") == k).select("query_id", "near").collect()}
    limit = np.array([least.get(q, -np.inf) for q in qids])
    second = possible & ~first & (bounds >= limit[:, None])
    index.seen[:] = [int(((first | second) * sizes).sum()), int(sizes.sum() * len(qids))]
    if second.any():
        found = found.unionByName(_round(placed, asked(second), qids, matrix, k, metric, floor, schema))
    score = -F.col("near") if metric == "Euclid" else F.col("near")
    hits = found.select("query_id", "id", score.alias("score"))
    return top_k(hits, "query_id", [F.col("score") if metric == "Euclid" else F.col("score").desc(), F.col("id")], k)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
