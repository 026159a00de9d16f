"""Vector collections, exact nearest-neighbour search and text embedding."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.functions.worker import fingerprint, once_per_worker
from sitemill.operators import store
from sitemill.session import materialize

# Metric names (anything else means Cosine) and search defaults.
METRICS = ("Cosine", "Euclid", "Dot")
DEFAULT_K = 10
#: Queries that are sent to every task, and that one block holds.
QUERY_BYTES = 16 * 1024 * 1024
#: Points of a block, and scores that are computed at once.
POINT_BLOCK, TILE_CELLS = 8_192, 1 << 21

POINTS = "id bigint, vector array<float>, payload map<string,string>"


def metric_name(distance: str) -> str:
    return distance if distance in METRICS else "Cosine"


def check_dimension(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Fail the job on a vector of another width."""
    wrong = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))
    return points.withColumn(
        vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(wrong))
    )


def create_collection(spark: SparkSession, root: str, dim: int, distance: str = "Cosine", buckets: int = store.BUCKETS) -> None:
    """An empty collection of a fixed width and metric; an existing one is left alone."""
    meta = spark.createDataFrame([(dim, metric_name(distance))], "dim int, metric string")
    meta.write.mode("ignore").json(f"{root}/meta")
    store.create(spark.createDataFrame([], POINTS), root, ["id"], buckets)


def collection_meta(spark: SparkSession, root: str) -> tuple[int, str]:
    row = spark.read.schema("dim int, metric string").json(f"{root}/meta").first()
    return row["dim"], row["metric"]


def read_points(spark: SparkSession, root: str) -> DataFrame:
    return store.read(spark, root)


def whole_points(batch: DataFrame) -> DataFrame:
    """A batch of points; a missing payload is empty."""
    empty = F.create_map().cast("map<string,string>")
    return batch.withColumn("payload", F.coalesce("payload", empty) if "payload" in batch.columns else empty)


def upsert_points(spark: SparkSession, root: str, batch: DataFrame, order: str | None = None) -> int:
    """The version after a batch: a known id is replaced whole. Only buckets that hold ids of the batch are rewritten; an empty batch writes nothing."""
    dim, _ = collection_meta(spark, root)
    return store.upsert(spark, root, whole_points(check_dimension(batch, dim)), order).number


def _scores(queries: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Scores where greater is nearer; distances are negated."""
    if metric == "Euclid":
        return -np.sqrt(
            np.maximum(
                (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * queries @ points.T, 0
            )
        )
    if metric == "Cosine":
        queries, points = (
            m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
            for m in (queries, points)
        )
    return queries @ points.T


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` rows of each query with the greatest ``near``, the smallest id among equals."""
    ordered = rows.sort_values(["q", "near", "id"], ascending=[True, False, True])
    return ordered[ordered.groupby("q").cumcount() < k]


def _hits(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, metric: str, floor: float | None) -> pd.DataFrame:
    """``q, id, near``: for each query the points up to the k-th nearest, with all that tie with it.

    Scores are computed for as many queries at once as ``TILE_CELLS`` allows.
    """
    found, step = [], max(1, TILE_CELLS // max(1, len(points)))
    for i in range(0, len(queries), step):
        near = _scores(queries[i : i + step], points, metric)
        least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else -np.inf
        keep = near >= least if floor is None else (near >= least) & (near >= floor)
        q, p = np.nonzero(keep)
        found.append(pd.DataFrame({"q": q + i, "id": ids[p], "near": near[q, p]}))
    return pd.concat(found, ignore_index=True)


def _answer(best: pd.DataFrame, qids: np.ndarray, metric: str) -> pd.DataFrame:
    return pd.DataFrame({"query_id": qids[best["q"]], "id": best["id"], "score": -best["near"] if metric == "Euclid" else best["near"]})


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _broadcast_search(points: DataFrame, queries: list, k: int, metric: str, floor: float | None, schema: str) -> DataFrame:
    """Every task holds all queries and keeps ``k`` rows for each."""
    sent = points.sparkSession.sparkContext.broadcast(
        (np.array([r["query_id"] for r in queries], dtype=object), np.array([r["vector"] for r in queries], dtype=np.float64))
    )

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, matrix = sent.value
        best = None
        for batch in batches:
            if len(batch):
                new = _hits(matrix, batch["id"].to_numpy(dtype=object), _stacked(batch["vector"]), k, metric, floor)
                best = _best(new if best is None else pd.concat([best, new]), k)
        if best is not None:
            yield _answer(best, qids, metric)

    return points.mapInPandas(local, schema)


def _blocked_search(points: DataFrame, queries: DataFrame, blocks: int, k: int, metric: str, floor: float | None, schema: str) -> DataFrame:
    """Points and queries in blocks; each pair of blocks is one group of bounded size."""
    sides = max(1, -(-points.count() // POINT_BLOCK))
    of_points = points.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(sides))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    of_queries = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long")))
    )

    def pair(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        qids = asked["query_id"].to_numpy(dtype=object)
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": qids[:0], "id": own["id"][:0], "score": np.zeros(0)})
        best = _best(_hits(_stacked(asked["vector"]), own["id"].to_numpy(dtype=object), _stacked(own["vector"]), k, metric, floor), k)
        return _answer(best, qids, metric)

    return of_points.groupBy("p", "b").cogroup(of_queries.groupBy("p", "b")).applyInPandas(pair, schema)


def search(
    points: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "Cosine",
    threshold: float | None = None,
    payload: str | None = None,
) -> DataFrame:
    """Exact ``k`` nearest points per query: ``query_id, id, score, rank`` and the ``payload`` column of the point.

    ``points`` has ``id, vector``; ``queries`` has ``query_id, vector``. Cosine and Dot rank
    by falling score and keep scores of at least ``threshold``, Euclid by rising distance
    up to it; ties by id. Each task keeps ``k`` rows per query, so only those are shuffled.

    Queries that are no more than ``QUERY_BYTES`` together are sent to every task. More are cut
    into blocks of that size and meet the points, in blocks too, by an equality join; the driver
    then holds no query.
    """
    metric = metric_name(metric)
    queries = materialize(queries.select("query_id", "vector"), "queries")
    dims, count = queries.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    if not count:
        carried = [F.col(payload)] if payload else []
        return points.limit(0).select(
            F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"),
            "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), *carried,
        )
    floor = None if threshold is None else (-threshold if metric == "Euclid" else threshold)
    id_type, qid_type = points.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qid_type}, id {id_type}, score double"
    own = check_dimension(points.select("id", "vector"), dims)
    blocks = -(-count * dims * 8 // QUERY_BYTES)
    if blocks <= 1:
        found = _broadcast_search(own, queries.collect(), k, metric, floor, schema)
    else:
        found = _blocked_search(own, check_dimension(queries, dims), blocks, k, metric, floor, schema)
    order = [F.col("score") if metric == "Euclid" else F.col("score").desc(), F.col("id")]
    hits = top_k(found, "query_id", order, k)
    return hits.join(points.select("id", payload), "id").select("query_id", "id", "score", "rank", payload) if payload else hits


def top_k(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group with their ``rank``; tasks cut to ``k`` before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class HashingEncoder:
    """Term counts hashed to ``dim`` buckets, scaled to unit length.

    Stands in for a pretrained sentence model, which needs a download. Any object with
    ``encode(list of texts) -> matrix`` can take its place.
    """

    def __init__(self, dim: int = 384):
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def bucket(self, term: str) -> int:
        found = self._bucket.get(term)
        if found is None:
            if len(self._bucket) > 1_000_000:
                self._bucket.clear()
            found = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim
            self._bucket[term] = found
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            terms = (text or "").lower().split()
            if terms:
                row += np.bincount([self.bucket(t) for t in terms], minlength=self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def embed(
    df: DataFrame,
    text: str,
    encoder: Callable[[], object] = HashingEncoder,
    out: str = "vector",
    tasks: int | None = None,
) -> DataFrame:
    """Add the embedding of ``text``, at the model's own width.

    ``encoder`` builds the model; it is called once per worker, whatever the number of tasks, and
    known by its fingerprint. ``tasks`` deals the rows out anew, for inputs that are few files.
    """
    df = df.repartition(tasks) if tasks else df
    key = fingerprint(encoder)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once_per_worker(key, encoder)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.tolist()).astype(np.float32)))

    # Not repeated where a filter on the vector is moved below it.
    once = encode.asNondeterministic()
    return df.withColumn(out, once(F.col(text)))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
