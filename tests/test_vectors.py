"""Search and clustering against brute force."""

import functools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill.functions import worker
from sitemill.operators import ballsearch, cluster, vectors


def frame(spark, matrix, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, vector array<float>").repartition(5)


def brute(points, queries, metric, k, threshold=None):
    points, queries = points.astype(np.float32).astype(float), queries.astype(np.float32).astype(float)
    out = set()
    for q, v in enumerate(queries):
        if metric == "Euclid":
            score = np.sqrt(((points - v) ** 2).sum(1))
        else:
            score = points @ v
            if metric == "Cosine":
                score = score / (np.linalg.norm(points, axis=1) * np.linalg.norm(v))
        key = score if metric == "Euclid" else -score
        order = sorted(range(len(points)), key=lambda i: (round(key[i], 9), i))
        if threshold is not None:
            order = [i for i in order if (score[i] <= threshold if metric == "Euclid" else score[i] >= threshold)]
        out |= {(q, i, r + 1, round(score[i], 5)) for r, i in enumerate(order[:k])}
    return out


@pytest.mark.parametrize(("metric", "threshold"), [("Cosine", None), ("Dot", 0.5), ("Euclid", 2.5), ("Unknown", None)])
def test_search(spark, metric, threshold, monkeypatch):
    # Blocks of two queries, so several scans are merged.
    monkeypatch.setattr(vectors, "QUERY_BYTES", 2 * 8 * 6)
    rng = np.random.default_rng(1)
    points, queries = rng.normal(size=(200, 6)), rng.normal(size=(5, 6))
    points[50] = points[51] = points[52]
    got = vectors.search(frame(spark, points), frame(spark, queries, "query_id"), 7, metric, threshold)
    rows = {(r["query_id"], r["id"], r["rank"], round(r["score"], 5)) for r in got.collect()}
    assert rows == brute(points, queries, "Cosine" if metric == "Unknown" else metric, 7, threshold)


def test_search_without_queries(spark):
    empty = spark.createDataFrame([], "query_id long, vector array<float>")
    assert vectors.search(frame(spark, np.eye(3)), empty).count() == 0


def test_search_rejects_other_widths(spark):
    with pytest.raises(Exception, match="expected 2 dimensions"):
        vectors.search(frame(spark, np.eye(3)), frame(spark, np.eye(2), "query_id")).collect()


def test_embedding_is_unit_and_model_is_built_once_per_task(spark, tmp_path):
    log = str(tmp_path / "built")

    class Model(vectors.HashingEncoder):
        def __init__(self):
            super().__init__(16)
            with open(log, "a") as f:
                f.write("x")

    df = spark.range(5000).coalesce(1).select("id", F.concat(F.lit("a b "), F.col("id").cast("string")).alias("t"))
    rows = vectors.embed(df, "t", Model).select("vector").collect()
    assert len(rows) == 5000 and len(open(log).read()) == 1
    assert all(len(r[0]) == 16 and abs(sum(x * x for x in r[0]) - 1) < 1e-5 for r in rows)


def reference_labels(matrix, min_size=2):
    """Single linkage hierarchy, condensed from the top and cut by excess of mass."""
    n = len(matrix)
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(-1))
    pairs = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    up, node, children, size = list(range(n)), list(range(n)), {}, {i: 1 for i in range(n)}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    nxt = n
    for w, i, j in pairs:
        a, b = find(i), find(j)
        if a == b:
            continue
        children[nxt] = (node[a], node[b], 1 / w)
        size[nxt] = size[node[a]] + size[node[b]]
        up[b] = a
        node[a] = nxt
        nxt += 1
    clusters = {0: [0.0, [], []]}  # birth, [(point, lambda)], [(child, lambda, size)]

    def leaves(t):
        return [t] if t < n else leaves(children[t][0]) + leaves(children[t][1])

    todo = [(nxt - 1, 0)]
    while todo:
        t, c = todo.pop()
        left, right, lam = children[t]
        big = [s for s in (left, right) if size[s] >= min_size]
        for s in (left, right):
            if size[s] < min_size:
                clusters[c][1] += [(p, lam) for p in leaves(s)]
        if len(big) == 2:
            for s in big:
                new = len(clusters)
                clusters[new] = [lam, [], []]
                clusters[c][2].append((new, lam, size[s]))
                todo.append((s, new))
        elif big:
            todo.append((big[0], c))

    def stable(c):
        birth, points, kids = clusters[c]
        own = sum(lam - birth for _, lam in points) + sum((lam - birth) * s for _, lam, s in kids)
        below = [stable(k) for k, _, _ in kids]
        if c and own >= sum(v for v, _ in below):
            return own, [c]
        return sum(v for v, _ in below), [x for _, w in below for x in w]

    def members(c):
        return [p for p, _ in clusters[c][1]] + [p for k, _, _ in clusters[c][2] for p in members(k)]

    groups = sorted(sorted(members(c)) for c in stable(0)[1])
    labels = [-1] * n
    for label, group in enumerate(groups):
        for p in group:
            labels[p] = label
    return labels


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 4)) * 4
    return np.concatenate([c + rng.normal(size=(s, 4)) * w for c, s, w in zip(centers, (50, 12, 9, 5, 3, 21), (0.3, 0.2, 0.6, 0.1, 0.2, 1.0), strict=True)]).astype(np.float32)


@pytest.mark.parametrize("options", [{}, {"block_points": 17, "level_edges": 30}])
def test_density(spark, blobs, options):
    got = cluster.density(frame(spark, blobs), **options)
    labels = [r["label"] for r in got.orderBy("id").collect()]
    assert labels == reference_labels(blobs.astype(float)) and max(labels) >= 3


def test_density_with_larger_clusters(spark, blobs):
    labels = [r["label"] for r in cluster.density(frame(spark, blobs), 6, level_edges=25).orderBy("id").collect()]
    assert labels == reference_labels(blobs.astype(float), 6)


def test_density_of_little(spark):
    assert cluster.density(frame(spark, np.zeros((0, 2)))).count() == 0
    assert [r["label"] for r in cluster.density(frame(spark, np.zeros((1, 2)))).collect()] == [-1]
    assert [r["label"] for r in cluster.density(frame(spark, np.eye(2))).collect()] == [-1, -1]


@pytest.mark.parametrize("level_edges", [40, 200_000])
def test_spanning_tree(spark, blobs, level_edges):
    tree = cluster.spanning_tree(frame(spark, blobs), 30, level_edges).collect()
    d = np.sqrt(((blobs[:, None].astype(float) - blobs[None]) ** 2).sum(-1))
    total = sum(w for _, _, w in cluster._tree(blobs.astype(float)))
    assert len(tree) == len(blobs) - 1 and abs(sum(r["w"] for r in tree) - total) < 1e-6
    assert all(abs(d[r["lo"], r["hi"]] - r["w"]) < 1e-6 for r in tree)


@pytest.mark.parametrize(("min_size", "level_edges"), [(2, 9), (5, 40)])
def test_density_in_many_levels(spark, min_size, level_edges):
    """Chains, nests and small groups, with levels of a few edges: what levels cannot know of each other is put in place."""
    rng = np.random.default_rng(7)
    chain = np.cumsum(rng.uniform(0.1, 0.2, size=(60, 1)) * [1, 0], axis=0)
    nest = np.concatenate([rng.normal(size=(8, 2)) * 0.01 * 3**k + [20 + 4 * 2**k, 5] for k in range(6)])
    matrix = np.concatenate([chain, nest, rng.normal(size=(40, 2)) * 8]).astype(np.float32)
    want = reference_labels(matrix.astype(float), min_size)
    got = cluster.density(frame(spark, matrix), min_size, block_points=20, level_edges=level_edges)
    assert [r["label"] for r in got.orderBy("id").collect()] == want


def test_looked_at_block_pairs_grow_with_the_points(spark):
    """On data of few dimensions the pairs of balls per ball, and the edges kept per point, do not grow."""
    seen = {}
    for n in (2_000, 8_000):
        matrix = np.random.default_rng(9).uniform(size=(n, 2)) * np.sqrt(n)
        edges, pairs = cluster.block_edges(frame(spark, matrix), 100)
        blocks = cluster.balls(frame(spark, matrix), 100).groupBy("block").count()
        assert blocks.agg(F.max("count")).first()[0] <= 100
        seen[n] = (pairs.count() / blocks.count(), edges.count() / n)
    assert seen[8_000][0] <= 1.5 * seen[2_000][0] and seen[8_000][1] <= 1.3 * seen[2_000][1] and seen[8_000][1] < 3


@pytest.mark.parametrize("level_edges", [15, 200_000])
def test_a_cloud_of_many_dimensions_gives_its_tree_and_no_other_edges(spark, level_edges):
    """Points that no bound parts, equal lengths, copies and groups that lie apart: the edges that rise by length, then ids, and n - 1 of them."""
    rng = np.random.default_rng(13)
    grid = np.pad(np.stack(np.meshgrid(range(5), range(5)), -1).reshape(-1, 2), ((0, 0), (0, 14)))
    matrix = np.concatenate([rng.normal(size=(150, 16)), grid + 30, np.ones((25, 16)), rng.normal(size=(30, 16)) * 0.01 - 20])
    matrix = matrix[rng.permutation(len(matrix))].astype(np.float32)
    found, _ = cluster.block_edges(frame(spark, matrix), 40, level_edges)
    x, up, want = matrix.astype(float), list(range(len(matrix))), set()
    for _, a, b in sorted((np.sqrt(((x[a : a + 1] - x[b]) ** 2).sum(1))[0], a, b) for b in range(len(x)) for a in range(b)):
        if up[a] != up[b]:
            old = up[b]
            up = [up[a] if c == old else c for c in up]
            want.add((a, b))
    rows = found.collect()
    assert len(rows) == len(matrix) - 1 and {(r["lo"], r["hi"]) for r in rows} == want


def test_copies_form_one_cluster(spark):
    # A third of the points are copies of one.
    rng = np.random.default_rng(5)
    matrix = np.concatenate([np.ones((30, 3)), rng.normal(size=(60, 3)) * 5]).astype(np.float32)
    labels = [r["label"] for r in cluster.density(frame(spark, matrix), block_points=16, level_edges=10).orderBy("id").collect()]
    assert len(set(labels[:30])) == 1 and labels[0] >= 0


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    class Counting:
        def __init__(self):
            import os
            import uuid

            open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(self, texts):
            return np.ones((len(texts), 2))

    docs = spark.range(400).select(F.col("id").cast("string").alias("text"))
    found = vectors.embed(docs, "text", Counting, tasks=40)
    assert found.rdd.getNumPartitions() == 40
    for _ in range(2):
        assert found.where("vector[0] = 1").count() == 400
    loads = os.listdir(folder)
    assert len(loads) == len({f.split("-")[0] for f in loads}) <= 16  # 80 tasks, one load in each worker


def test_a_worker_keeps_a_few_things():
    made = []
    for key in "abcabcda":
        worker.once_per_worker(f"t{key}", lambda key=key: made.append(key) or key, most=3)
    assert made == list("abcd") + ["a"]
    assert worker.fingerprint(functools.partial(vectors.HashingEncoder, 8)) != worker.fingerprint(functools.partial(vectors.HashingEncoder, 9))


@pytest.mark.parametrize(("metric", "threshold"), [("Cosine", None), ("Euclid", None), ("Dot", None), ("Euclid", 9.0), ("Cosine", 0.9)])
def test_search_over_balls_gives_the_same_rows_and_scores_less(spark, tmp_path, metric, threshold):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 8)) * 10
    points = np.concatenate([centers[i % 12] + rng.normal(size=(1, 8)) for i in range(1_200)] + [np.zeros((2, 8)), centers[:1], centers[:1]])
    asked = np.concatenate([centers[:9] + 0.1, rng.normal(size=(2, 8)), np.zeros((1, 8))])
    own, queries = frame(spark, points), frame(spark, asked, "query_id")
    index = ballsearch.build(own, str(tmp_path / "index"), metric, 60)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    for k in (1, 10):
        got = ballsearch.search(spark, index, queries.where("query_id < 9"), k, threshold)
        assert rows(got) == rows(vectors.search(own, queries.where("query_id < 9"), k, metric, threshold))
        scored, pairs = index.seen
        assert scored < pairs / 2, (scored, pairs)
    assert rows(ballsearch.search(spark, index, queries, 3, threshold)) == rows(vectors.search(own, queries, 3, metric, threshold))
    assert ballsearch.search(spark, index, queries.limit(0)).count() == 0
    with pytest.raises(Exception, match="expected 8 dimensions"):
        ballsearch.search(spark, index, frame(spark, np.ones((1, 3)), "query_id")).collect()
