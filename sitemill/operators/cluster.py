"""Density clustering of vectors: minimum spanning tree, cluster hierarchy, flat labels.

With one neighbour as core sample the mutual reachability distance is the Euclidean
distance, so the hierarchy is that of the minimum spanning tree.

No step sees all points or all edges. Points lie in balls of a bounded size, and bounds on distances tell
which pairs of balls may hold a tree edge. Every point gets its few nearest others from matrix products over pairs of
balls; a component takes its lightest edge as soon as none unseen can be lighter, and only the points that keep one in doubt
search again. Edges of the tree lie in levels of a bounded size by length;
what the edges of all shorter levels join is contracted in a number of rounds that grows with the
logarithm of the number of levels, and then all levels grow their part of the hierarchy at
once, each connected part of a level on its own.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.operators.ranking import number_rows
from sitemill.session import materialize

MIN_BLOCK, MAX_BLOCK = 256, 4096
#: Blocks that points are aimed to lie in at most; more points make larger blocks. A few numbers per block come to the driver.
MOST_BLOCKS = 5_000
LEVEL_EDGES = 200_000
#: Blocks that one block is split into at once.
SPLIT = 256
#: Bounds are compared with room for rounding.
ROOM = 1 + 1e-9
#: Edges that a search gives for a point.
NEAREST = 8
#: Points of the groups of blocks that meet in a task, rows of a matrix product, and candidates whose distances are worked out at once.
GROUP, STRIP, SLICE = 32_768, 512, 1 << 16


def _tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree of a block pair, grown point by point over a row of distances."""
    n = len(points)
    near = np.full(n, np.inf)
    source = np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    at, edges = 0, []
    for _ in range(n - 1):
        outside[at] = False
        step = np.sqrt(((points - points[at]) ** 2).sum(1))
        closer = outside & (step < near)
        near[closer], source[closer] = step[closer], at
        at = int(np.argmin(np.where(outside, near, np.inf)))
        edges.append((int(source[at]), at, float(near[at])))
    return edges


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (centers**2).sum(1)[None] - 2 * points @ centers.T, 0))


def balls(points: DataFrame, block_points: int | None = None) -> DataFrame:
    """``id, vector, block``: points by their nearest pivot, again and again until no block is too large.

    Pivots are points of the block, drawn by hash, about two per block that is wanted. A block
    that does not part this way (equal points) is parted by hash.
    """
    n = points.count()
    size = max(block_points or min(MAX_BLOCK, max(MIN_BLOCK, n // 16)), -(-n // MOST_BLOCKS))
    placed = points.select("id", "vector", F.lit(0).cast("long").alias("block"))
    origin: dict[int, int] = {}
    sizes, first = {0: n}, 1
    while large := {b: k for b, k in sizes.items() if k > size}:
        wanted = {b: min(SPLIT, -(-2 * k // size)) for b, k in large.items()}
        stuck = {b for b in large if origin.get(b) == large[b]}
        order = Window.partitionBy("block").orderBy(F.xxhash64("id", F.lit(first)), "id")
        many = points.sparkSession.createDataFrame(sorted(wanted.items()), "block long, wanted int")
        drawn = placed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SPLIT).join(F.broadcast(many), "block").where("n <= wanted")
        pivots: dict[int, list] = {}
        for r in drawn.select("block", "vector").collect():  # two per wanted block
            pivots.setdefault(r["block"], []).append(r["vector"])
        parts, origin = {}, {}
        for b, k in wanted.items():
            parts[b] = (first, k, None if b in stuck else np.array(pivots[b], np.float64))
            origin |= dict.fromkeys(range(first, first + k), large[b])
            first += k
        sent = points.sparkSession.sparkContext.broadcast(parts)

        @F.pandas_udf("long")
        def nearest(block: pd.Series, vector: pd.Series, mark: pd.Series) -> pd.Series:
            out = block.to_numpy().copy()
            for b in np.unique(out):
                if b in sent.value:
                    start, k, centers = sent.value[b]
                    rows = np.flatnonzero(block.to_numpy() == b)
                    if centers is None:
                        out[rows] = start + mark.to_numpy()[rows] % k
                    else:
                        out[rows] = start + _distances(np.stack(vector.iloc[rows].to_list()).astype(np.float64), centers).argmin(1)
            return pd.Series(out)

        mark = F.pmod(F.xxhash64(F.lit(first), "id"), F.lit(1 << 30))
        placed = materialize(placed.select("id", "vector", nearest("block", "vector", mark).alias("block")), "balls")
        sizes = {r["block"]: r["n"] for r in placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    return placed


def _needed(facts: pd.DataFrame, edges: list[tuple[int, int, float]]):
    """A function of a block number: the later blocks with which it may share a tree edge, and how long that is at most.

    The trees of the blocks and the tree of their middles (``edges``, in the order in which it
    was grown) connect all points. An edge of the whole tree is no longer than the longest on that
    way between its ends. Between two middles that is the longest edge added after the first of
    them and up to the second.
    """
    order = np.array([0, *[b for _, b, _ in edges]])
    place = np.argsort(order)
    added = np.array([0.0, *[w for _, _, w in edges]])
    centers = np.stack(facts["center"].to_list())
    radius, longest = facts["radius"].to_numpy(), facts["longest"].to_numpy()

    def run(x: int) -> tuple[np.ndarray, np.ndarray]:
        at = place[x]
        way = np.zeros(len(order))
        way[at + 1 :] = np.maximum.accumulate(added[at + 1 :])
        way[:at] = np.maximum.accumulate(added[1 : at + 1][::-1])[::-1]
        most = np.maximum(np.maximum(longest[x], longest), way[place]) * ROOM
        apart = np.sqrt(((centers - centers[x]) ** 2).sum(1)) - (radius[x] + radius) * ROOM
        later = np.flatnonzero((apart <= most) & (np.arange(len(order)) > x))
        return later, most[later]

    return run


def block_pairs(facts: pd.DataFrame, edges: list, spark) -> DataFrame:
    """``x, y, most`` of the block numbers whose blocks are looked at together."""
    sent = spark.sparkContext.broadcast((facts, edges))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needed = _needed(*sent.value)
        for batch in batches:
            for x in batch["id"]:
                y, most = needed(int(x))
                yield pd.DataFrame({"x": int(x), "y": y, "most": most})

    return spark.range(len(facts)).mapInPandas(pairs, "x long, y long, most double")


def _longest(points: np.ndarray) -> float:
    """The longest edge of a tree of the points that is the least one but for rounding."""
    n, sq = len(points), (points**2).sum(1)
    near, source = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    inside, at, longest = np.zeros(n), 0, 0.0
    for _ in range(n - 1):
        inside[at] = np.inf
        step = sq - 2 * (points @ points[at]) + sq[at]
        closer = step < near
        near[closer], source[closer] = step[closer], at
        at = int(np.argmin(near + inside))
        longest = max(longest, float(np.sqrt(((points[at] - points[source[at]]) ** 2).sum())))
    return longest


class _Lists:
    """The lightest edges of the points of a block, of those offered: at most ``NEAREST`` of each, none above its limit."""

    def __init__(self, limits: np.ndarray):
        self.limits, self.parts, self.waiting = limits, [], 0

    def offer(self, row: np.ndarray, q: np.ndarray, w: np.ndarray) -> None:
        self.parts.append((row, q, w))
        self.waiting += len(row)
        if self.waiting > 2 * NEAREST * len(self.limits):
            self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``row, q, w`` by row, then lightest first; where a list of ``NEAREST`` ends."""
        if not self.parts:
            self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        row, q, w = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((q, w, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < NEAREST
        row, q, w, last = row[keep], q[order][keep], w[order][keep], place[keep] == NEAREST - 1
        self.limits[row[last]] = np.minimum(self.limits[row[last]], w[last])
        self.parts, self.waiting = [(row, q, w)], 0
        return row, q, w, last


class _Block:
    def __init__(self, ids, comps, limits, vectors: bytes):
        self.ids = np.asarray(ids, np.int64)
        self.comps = np.asarray(comps, np.int64)
        self.limits = np.array(limits, np.float64)
        self.points = np.frombuffer(vectors, np.float64).reshape(len(self.ids), -1)
        self.center = self.points.mean(0)
        self.radius = float(np.sqrt(((self.points - self.center) ** 2).sum(1)).max())


def _meet(own: _Block, lists: _Lists, other: _Block, most: float) -> None:
    """Offers ``lists`` the edges from points of one block to points of the other that lie in another component."""
    asked = np.flatnonzero(lists.limits >= 0)
    away = np.sqrt(((own.points[asked] - other.center) ** 2).sum(1)) - other.radius * ROOM
    asked = asked[away <= np.minimum(lists.limits[asked], most) * ROOM]
    kinds = np.unique(other.comps)
    if len(kinds) == 1:
        asked = asked[own.comps[asked] != kinds[0]]
    if not len(asked):
        return
    mixed = len(kinds) < len(other.ids) and bool(np.isin(own.comps[asked], kinds).any())
    # Half the square of a distance is half the square of p less the product of (p, -1) and (t, half the square of t).
    there = other.points - own.center
    there_sq = (there**2).sum(1)
    wide = np.column_stack([there, there_sq / 2])
    for s in range(0, len(asked), STRIP):
        rows = asked[s : s + STRIP]
        here = own.points[rows] - own.center
        here_sq = (here**2).sum(1)
        room = 1e-12 * (here_sq.max() + there_sq.max())
        near = np.column_stack([here, np.full(len(rows), -1.0)]) @ wide.T
        if mixed:
            near[own.comps[rows][:, None] == other.comps[None]] = -np.inf
        limit = np.minimum(lists.limits[rows], most) * ROOM
        least = (here_sq - limit**2) / 2 - room
        hit = near >= least[:, None]
        if near.shape[1] > NEAREST + 1 and np.count_nonzero(hit) > 8 * NEAREST * len(rows):
            kth = near.shape[1] - NEAREST - 1  # a point meets itself
            least = np.maximum(least, np.partition(near, kth, axis=1)[:, kth] - 2 * room)
            hit = near >= least[:, None]
        if mixed:
            hit &= near > -np.inf
        i, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
        for k in range(0, len(i), SLICE):
            row, at = i[k : k + SLICE], j[k : k + SLICE]
            w = np.sqrt(((own.points[rows[row]] - other.points[at]) ** 2).sum(1))
            keep = (own.comps[rows[row]] != other.comps[at]) & (w <= limit[row])
            lists.offer(rows[row[keep]], other.ids[at[keep]], w[keep])


def _search(blocks: DataFrame, tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """``p, q, w, last``: the lightest edges to other components of each point with a limit of 0 or more, none above it.

    ``blocks`` has ``x, ids, comps, limits, vectors`` (a row per block), ``tiles`` the blocks ``x, y`` that meet and ``most``. Blocks
    meet in groups, a task each pair of groups. ``last`` marks the end of a list of ``NEAREST``: what
    is not in it is heavier.
    """
    placed = blocks.join(groups, "x")
    dealt = tiles.join(groups.withColumnRenamed("grp", "g"), "x").join(groups.select(F.col("x").alias("y"), F.col("grp").alias("h")), "y")
    dealt = materialize(dealt.groupBy("g", "h").agg(F.collect_list(F.struct("x", "y", "most")).alias("t")), "tiles")
    names = ["x", "ids", "comps", "limits", "vectors"]
    empty = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in names]
    lists = [F.lit(None).cast(k).alias(c) for c, k in (("xs", "array<long>"), ("ys", "array<long>"), ("mosts", "array<double>"))]
    sides = [dealt.select("g", "h").join(placed.withColumnRenamed("grp", end), end).select("g", "h", F.lit(n).alias("side"), *names, *lists) for n, end in enumerate("gh")]
    given = dealt.select("g", "h", F.lit(2).alias("side"), *empty, F.col("t.x").alias("xs"), F.col("t.y").alias("ys"), F.col("t.most").alias("mosts"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        side = [{r.x: _Block(r.ids, r.comps, r.limits, r.vectors) for r in rows[rows["side"] == n].itertuples()} for n in (0, 1)]
        tile = rows[rows["side"] == 2].iloc[0]
        xs, ys, mosts = np.asarray(tile["xs"]), np.asarray(tile["ys"]), np.asarray(tile["mosts"])
        found = []
        for x, own in side[0].items():
            at = np.flatnonzero(xs == x)
            if not len(at) or not (own.limits >= 0).any():
                continue
            apart = [((side[1][y].center - own.center) ** 2).sum() for y in ys[at]]
            lists = _Lists(own.limits)
            for k in at[np.argsort(apart)]:
                _meet(own, lists, side[1][ys[k]], mosts[k])
            row, q, w, _ = lists.settled()
            found.append((x, own.ids[row].tobytes(), q.tobytes(), w.tobytes()))
        return pd.DataFrame(found, columns=["x", "p", "q", "w"], dtype=object)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        p, q, w = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("p", np.int64), ("q", np.int64), ("w", np.float64)))
        ids, row = np.unique(p, return_inverse=True)
        lists = _Lists(np.full(len(ids), np.inf))
        lists.parts = [(row, q, w)]
        row, q, w, last = lists.settled()
        return pd.DataFrame({"p": ids[row], "q": q, "w": w, "last": last})

    every = sides[0].unionByName(sides[1]).unionByName(given)
    parts = every.groupBy("g", "h").applyInPandas(meet, "x long, p binary, q binary, w binary")
    return parts.groupBy("x").applyInPandas(merge, "p long, q long, w double, last boolean")


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """Takes edges in rising order, where either end's component has no unseen edge that is lighter: ``lo, hi, w`` and ``comp, root``.

    An edge that is passed over stays in doubt, as the least bound of a component never rises here.
    """
    forest, low, kept = _Forest(), {}, []
    for end in "ab":
        low |= {c: (w, lo, hi) for c, w, lo, hi in zip(*(rows[c] for c in (end, f"{end}_w", f"{end}_lo", f"{end}_hi")), strict=True)}
    for a, b, w, lo, hi in sorted(zip(*(rows[c] for c in ("a", "b", "w", "lo", "hi")), strict=True), key=lambda e: e[2:]):
        a, b = forest.find(a), forest.find(b)
        if a != b and (w, lo, hi) <= max(low[a], low[b]):
            least = min(low[a], low[b])
            low[forest.join(a, b)] = least
            kept.append((lo, hi, w, None, None))
    kept += [(None, None, None, c, r) for c in low if (r := forest.find(c)) != c]
    return pd.DataFrame(kept, columns=["lo", "hi", "w", "comp", "root"], dtype=object)


def _lightest(edges: DataFrame) -> DataFrame:
    """``comp, edge, other``: the lightest known edge of each component and where it leads."""
    edge = F.struct("w", "lo", "hi").alias("edge")
    ends = edges.select(F.col("a").alias("comp"), edge, F.col("b").alias("other")).unionAll(edges.select("b", edge, "a"))
    return ends.groupBy("comp").agg(F.min(F.struct("edge", "other")).alias("m")).select("comp", "m.edge", "m.other")


def _joined(chosen: DataFrame) -> DataFrame:
    """``comp, root`` for components that each follow their lightest edge to another; only two can choose the same edge."""
    back = chosen.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    ways = chosen.select("comp", "other").join(back, "other", "left").where("back IS NULL OR back <> comp OR comp > other").select("comp", F.col("other").alias("root"))
    while True:
        for _ in range(3):
            further = ways.select(F.col("comp").alias("root"), F.col("root").alias("next"))
            ways = ways.join(further, "root", "left").select("comp", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        ways = materialize(ways, "ways")
        if ways.where("moved").isEmpty():
            return ways.select("comp", "root")


def _renamed(rows: DataFrame, end: str, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("comp", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")


def _forest_of(nodes: DataFrame, edges: DataFrame, level_edges: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Takes every edge that is known to be a tree edge: nodes and edges with the components so far, and what was taken.

    ``nodes`` has ``id, x, comp, low``; an edge of that point that is not known comes after ``low``
    (null: there is none). ``edges`` has ``a, b`` (components), ``w, lo, hi``. The lightest known edge of a
    component is one of the tree when no point of the component can have a lighter one.
    """
    taken = []
    while True:
        pair = edges.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).where("a <> b")
        edges = materialize(pair.groupBy("a", "b").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("a", "b", "e.*"), "between")
        lows = nodes.groupBy("comp").agg(F.min("low").alias("low"))
        few = edges.limit(level_edges + 1).count() <= level_edges
        if few:
            given, none = edges, {"w": float("inf"), "lo": 0, "hi": 0}
            for end in "ab":
                given = given.join(lows.select(F.col("comp").alias(end), *[F.coalesce(f"low.{c}", F.lit(v)).alias(f"{end}_{c}") for c, v in none.items()]), end)
            found = materialize(given.groupBy().applyInPandas(_sweep, "lo long, hi long, w double, comp long, root long"), "swept")
            taken.append(found.where("lo IS NOT NULL").select("lo", "hi", "w"))
            roots = found.where("comp IS NOT NULL").select("comp", "root")
        else:
            chosen = materialize(_lightest(edges).join(lows, "comp").where("low IS NULL OR edge <= low"), "chosen")
            if chosen.isEmpty():
                return nodes, edges, taken
            taken.append(chosen.select("edge.lo", "edge.hi", "edge.w").distinct())
            roots = _joined(chosen)
        nodes = materialize(_renamed(nodes, "comp", roots), "nodes")
        edges = _renamed(_renamed(edges, "a", roots), "b", roots).where("a <> b")
        if few:
            return nodes, materialize(edges, "between"), taken


def block_edges(points: DataFrame, block_points: int | None = None, level_edges: int = LEVEL_EDGES) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning tree ``lo, hi, w`` of all points (of equal lengths the smaller ids), and the block pairs looked at.

    Equal points hang on the smallest of them. Of the others each has its nearest ones searched, and components
    grow along edges that are certain. Where all that is left is in doubt, the points that cause it,
    but for those of the largest component, search beyond their component.
    """
    spark, id_type = points.sparkSession, points.schema["id"].dataType
    numbered = None
    if id_type.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        numbered = materialize(number_rows(points.select("id"), ["id"], "n"), "numbered")
        points = points.join(numbered, "id").select(F.col("n").alias("id"), "vector")
    points = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    single = materialize(points.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "single")
    copied = single.where("n > 1").select("vector", F.col("id").alias("lo"))
    tree = [points.join(copied, "vector").where("id <> lo").select("lo", F.col("id").alias("hi"), F.lit(0.0).alias("w"))] if not copied.isEmpty() else []
    placed = balls(single.select("id", "vector"), block_points)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        matrix = np.stack(rows["vector"].to_list()).astype(np.float64)
        center = matrix.mean(0)
        away = np.sqrt(((matrix - center) ** 2).sum(1))
        limits, room = np.full(len(rows), np.inf), 1e-12 * (away.max() ** 2)
        if len(rows) > NEAREST:
            for s in range(0, len(rows), STRIP):
                nearest = np.partition(_distances(matrix[s : s + STRIP] - center, matrix - center), NEAREST, axis=1)[:, NEAREST]
                limits[s : s + STRIP] = np.sqrt(nearest**2 + 4 * room) * ROOM
        found = (key[0], rows["id"].to_list(), limits, matrix.tobytes(), _longest(matrix - center), center, away.max(), matrix[away.argmin()])
        return pd.DataFrame([found], columns=["block", "ids", "limits", "vectors", "longest", "center", "radius", "middle"], dtype=object)

    packed = materialize(
        placed.groupBy("block").applyInPandas(pack, "block long, ids array<long>, limits array<double>, vectors binary, longest double, center array<double>, radius double, middle array<double>"),
        "packed",
    )
    facts = packed.select("block", F.size("ids").alias("n"), "longest", "center", "radius", "middle").orderBy("block").toPandas()
    pairs = spark.createDataFrame([], "x long, y long, most double")
    if len(facts) > 1:
        # One row per block from here on the driver: their middles' tree.
        pairs = materialize(block_pairs(facts, _tree(np.stack(facts["middle"].to_list())), spark), "pairs")
    if len(facts):
        before = facts["n"].cumsum() - facts["n"]
        size = min(GROUP, max(1, int(facts["n"].sum()) // 8))
        numbers = spark.createDataFrame([(int(b), i, int(k) // size) for i, (b, k) in enumerate(zip(facts["block"], before, strict=True))], "block long, x long, grp long")
        groups = numbers.select("x", "grp")
        blocks = packed.join(numbers, "block").select("x", "ids", F.col("ids").alias("comps"), "limits", "vectors")
        alone = numbers.select("x", F.col("x").alias("y"), F.lit(float("inf")).alias("most"))
        tiles = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "most")).unionByName(alone)
        tree += _grown(blocks, tiles, groups, level_edges)
    every = reduce(DataFrame.unionByName, tree, spark.createDataFrame([], "lo long, hi long, w double"))
    if numbered is not None:
        for end in ("lo", "hi"):
            every = every.join(numbered.select(F.col("n").alias(end), "id"), end).drop(end).withColumnRenamed("id", end)
    return every.select(F.col("lo").cast(id_type).alias("lo"), F.col("hi").cast(id_type).alias("hi"), "w"), pairs


def _grown(blocks: DataFrame, tiles: DataFrame, groups: DataFrame, level_edges: int) -> list[DataFrame]:
    """The tree of the points of ``blocks``, in parts."""
    found = materialize(_search(blocks, tiles, groups), "nearest")
    edge = F.struct("w", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    last = found.where("last").select(F.col("p").alias("id"), edge.alias("low"))
    nodes = materialize(blocks.select("x", F.explode("ids").alias("id")).join(last, "id", "left").select("id", "x", F.col("id").alias("comp"), "low"), "nodes")
    edges = found.select(F.col("p").alias("a"), F.col("q").alias("b"), edge.alias("e")).select("a", "b", "e.*")
    tree = []
    while True:
        nodes, edges, taken = _forest_of(nodes, edges, level_edges)
        tree += taken
        sizes = nodes.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect()
        if len(sizes) < 2:
            return tree
        best = _lightest(edges).select("comp", "edge")
        doubt = (F.col("comp") != sizes[0]["comp"]) & F.col("low").isNotNull() & (F.col("edge").isNull() | (F.col("low") < F.col("edge")))
        marked = nodes.join(best, "comp", "left").withColumn("limit", F.when(doubt, F.coalesce("edge.w", F.lit(float("inf")))).otherwise(-1.0))
        marked = materialize(marked.select("id", "x", "comp", "low", "limit"), "marked")
        each = marked.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("id", "comp", "limit"))).alias("m"), F.max("limit").alias("most"))
        asking = each.where("most >= 0").select("x")
        found = materialize(_search(blocks.drop("comps", "limits").join(each.select("x", F.col("m.comp").alias("comps"), F.col("m.limit").alias("limits")), "x"), tiles.join(asking, "x"), groups), "nearest")
        last = found.where("last").select(F.col("p").alias("id"), edge.alias("end"))
        # A list that is not full has all there is up to the limit.
        beyond = F.when(F.col("limit") < float("inf"), F.struct(F.col("limit").alias("w"), F.lit(sys.maxsize).alias("lo"), F.lit(sys.maxsize).alias("hi")))
        low = F.when(F.col("limit") < 0, F.col("low")).otherwise(F.coalesce("end", beyond))
        nodes = materialize(marked.join(last, "id", "left").select("id", "x", "comp", low.alias("low")), "nodes")
        comps = nodes.select("id", "comp")
        new = found.select("p", "q", edge.alias("e")).join(comps.toDF("p", "a"), "p").join(comps.toDF("q", "b"), "q").select("a", "b", "e.*")
        edges = edges.unionByName(new)


def _components(edges: DataFrame) -> DataFrame:
    """``rec, node, root`` of the nodes on ``rec, a, b``: the smallest node that is reachable in the same ``rec``.

    A node takes the smallest label next to it, then its label's label, until nothing changes.
    """
    both = materialize(edges.select("rec", "a", "b").unionAll(edges.select("rec", "b", "a")).distinct(), "links")
    labels = both.groupBy("rec", F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    while True:
        labels = materialize(labels, "labels")
        near = both.join(labels.select("rec", F.col("node").alias("b"), "root"), ["rec", "b"]).groupBy("rec", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, ["rec", "node"]).select("rec", "node", "root", F.least("root", "near").alias("low"))
        up = labels.select("rec", F.col("node").alias("low"), F.col("root").alias("up"))
        labels = materialize(low.join(up, ["rec", "low"]).select("rec", "node", F.least("low", "up").alias("root"), (F.least("low", "up") != F.col("root")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("rec", "node", "root")
        labels = labels.select("rec", "node", "root")


def levels(edges: DataFrame, level_edges: int = LEVEL_EDGES) -> DataFrame:
    """``level, grp, rank, lo, hi, w, u, v, u_size, v_size``: edges by rising length in levels of about ``level_edges``.

    ``u`` and ``v`` are the components of the ends under all edges of earlier levels (named by their
    smallest point) with their sizes; edges inside one are gone. ``grp`` is the connected part of the level.

    Halves of the range of levels are contracted together: in each round the lighter half of every
    range gives the components for its heavier half.
    """
    n = edges.count()
    count = max(1, -(-n // level_edges))
    ranked = Window.partitionBy("level").orderBy("w", "lo", "hi")
    ranged = edges.repartitionByRange(count, "w", "lo", "hi").withColumn("level", F.spark_partition_id().cast("long")) if count > 1 else edges.withColumn("level", F.lit(0).cast("long"))
    ranged = materialize(ranged, "levels")
    table = ranged.withColumn("rank", F.shiftleft("level", 32) + F.row_number().over(ranked)).withColumns({"u": F.col("lo"), "v": F.col("hi")})
    if count == 1:
        one = F.lit(1).cast("long")
        return table.select("level", F.lit(None).cast(edges.schema["lo"].dataType).alias("grp"), "rank", "lo", "hi", "w", "u", "v", one.alias("u_size"), one.alias("v_size"))
    width = 1 << (count - 1).bit_length()
    table = materialize(table.withColumn("rec", F.lit(0).cast("long")), "contract")
    sizes = materialize(table.select("rec", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("size", F.lit(1).cast("long")), "sizes")
    while width > 1:
        width //= 2
        light = table.where(F.floor(F.col("level") / width) % 2 == 0)
        roots = materialize(_components(light.select("rec", F.col("u").alias("a"), F.col("v").alias("b"))), "roots")

        def named(rows: DataFrame, end: str, roots: DataFrame = roots) -> DataFrame:
            found = rows.join(roots.select("rec", F.col("node").alias(end), "root"), ["rec", end], "left")
            return found.withColumn(end, F.coalesce("root", end)).drop("root")

        heavy = named(named(table.where(F.floor(F.col("level") / width) % 2 == 1), "u"), "v").where("u <> v")
        grown = named(sizes, "node").groupBy("rec", "node").agg(F.sum("size").alias("size"))
        after = F.floor(F.col("level") / width).cast("long")
        table = materialize(light.unionByName(heavy).withColumn("old", F.col("rec")).withColumn("rec", after), "contract")
        # Sizes of the ends that each half still has.
        ends = table.select("rec", "old", F.explode(F.array("u", "v")).alias("node")).distinct()
        first = ends.where(F.col("rec") % 2 == 0).join(sizes.withColumnRenamed("rec", "old"), ["old", "node"])
        second = ends.where(F.col("rec") % 2 == 1).join(grown.withColumnRenamed("rec", "old"), ["old", "node"])
        sizes = materialize(first.unionByName(second).select("rec", "node", "size"), "sizes")
        table = table.drop("old")
    groups = _components(table.select("rec", F.col("u").alias("a"), F.col("v").alias("b")))
    for end in ("u", "v"):
        table = table.join(sizes.select("rec", F.col("node").alias(end), F.col("size").alias(f"{end}_size")), ["rec", end])
    table = table.join(groups.select("rec", F.col("node").alias("u"), F.col("root").alias("grp")), ["rec", "u"])
    return table.select("level", "grp", "rank", "lo", "hi", "w", "u", "v", "u_size", "v_size")


class _Forest:
    """Components named by their smallest member."""

    def __init__(self):
        self.up: dict = {}

    def find(self, c):
        self.up.setdefault(c, c)
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def join(self, a, b):
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        return low


def spanning_tree(points: DataFrame, block_points: int | None = None, level_edges: int = LEVEL_EDGES) -> DataFrame:
    """Minimum spanning tree of ``id, vector`` points as ``lo, hi, w``, n - 1 edges."""
    return block_edges(points.select("id", "vector"), block_points, level_edges)[0]


def _grow(edges: pd.DataFrame, min_size: int) -> list[tuple]:
    """Join components along edges of rising length and keep account of their clusters.

    A component of ``min_size`` points has a cluster. When a component joins one with a
    cluster, its points leave that cluster (seen from the top) at 1/length; when two
    clusters meet both end there, and their union starts a new one, known by its edge's rank.

    A component that comes with a cluster does not know which; that cluster is named by the component
    (``of``). Rows are ``kind, comp, rank, of, parent, value, wins``: ``mass`` that a cluster gathers,
    ``ended`` ones (value: points times 1/length there), those ``done`` whose stability is settled here,
    the clusters that components ``entered``, small components that ``moved`` into larger ones, and
    the cluster with which a component goes ``out``.
    """
    forest, info, rows = _Forest(), {}, []
    edges = edges.sort_values("rank")
    for rank, u, v, us, vs, w in zip(*(edges[c] for c in ("rank", "u", "v", "u_size", "v_size", "w")), strict=True):
        for c, size in ((u, us), (v, vs)):
            if c not in forest.up:
                forest.find(c)
                small = size < min_size
                # points, cluster, mass gathered here, stability below, all of it known, small members
                info[c] = (int(size), None if small else (None, c), 0.0, 0.0, False, [c] if small else [])
        a, b = forest.find(u), forest.find(v)
        if a == b:
            continue
        lam, rank = 1.0 / max(w, sys.float_info.min), int(rank)
        one, two = info.pop(a), info.pop(b)
        root, size = forest.join(a, b), one[0] + two[0]
        if one[1] and two[1]:
            inner, known = 0.0, True
            for n, cluster, mass, below, settled, _ in (one, two):
                if settled:
                    own = mass - n * lam
                    inner += max(own, below)
                    rows.append(("done", None, cluster[0], None, rank, max(own, below), own >= below))
                else:
                    known = False
                    rows.append(("ended", None, *cluster, rank, n * lam, None))
                    rows.append(("mass", None, *cluster, None, mass, None))
            info[root] = (size, (rank, None), size * lam, inner, known, [])
        elif not one[1] and not two[1]:
            if size < min_size:
                info[root] = (size, None, 0.0, 0.0, False, one[5] + two[5])
                continue
            rows += [("entered", c, rank, None, None, None, None) for c in one[5] + two[5]]
            info[root] = (size, (rank, None), size * lam, 0.0, True, [])
        else:
            (n, cluster, mass, below, settled, _), late = (one, two) if one[1] else (two, one)
            rows += [("entered", c, *cluster, None, None, None) for c in late[5]]
            info[root] = (size, cluster, mass + late[0] * lam, below, settled, [])
    for root, (_, cluster, mass, _, _, small) in info.items():
        if cluster:
            rows.append(("out", root, *cluster, None, None, None))
            rows.append(("mass", None, *cluster, None, mass, None))
        else:
            rows += [("moved", c, None, root, None, None, None) for c in small]
    return rows


def _named_clusters(events: DataFrame) -> DataFrame:
    """``of, level, cluster``: the cluster that a component comes with to a level.

    It is the one with which the component went out of the last level before that it was in, which
    may in turn have been named by a component; such ways are followed by doubling.
    """
    asked = events.where("of IS NOT NULL AND kind <> 'moved'").select(F.col("of").alias("comp"), "level").distinct()
    outs = events.where("kind = 'out'").select("comp", "level", "rank", "of")
    nothing = F.lit(None)
    both = outs.select("comp", "level", (F.col("level") * 2 + 1).alias("at"), F.struct("rank", "of", "level").alias("way")).unionByName(
        asked.select("comp", "level", (F.col("level") * 2).alias("at"), nothing.alias("way"))
    )
    before = Window.partitionBy("comp").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ways = both.withColumn("last", F.last("way", ignorenulls=True).over(before)).where("way IS NULL")
    ways = materialize(ways.select("comp", "level", F.col("last.rank").alias("cluster"), F.col("last.of").alias("of"), F.col("last.level").alias("since")), "ways")
    while not ways.where("cluster IS NULL").isEmpty():
        further = ways.select(F.col("comp").alias("of"), F.col("level").alias("since"), F.col("cluster").alias("c2"), F.col("of").alias("o2"), F.col("since").alias("s2"))
        known, open_ = ways.where("cluster IS NOT NULL"), ways.where("cluster IS NULL")
        gone = open_.join(further, ["of", "since"]).select("comp", "level", F.col("c2").alias("cluster"), F.col("o2").alias("of"), F.col("s2").alias("since"))
        ways = materialize(known.unionByName(gone), "ways")
    return ways.select(F.col("comp").alias("of"), "level", "cluster")


def _values(nodes: DataFrame) -> DataFrame:
    """``cluster, parent, own, value`` of clusters whose stability depends on other levels.

    ``nodes`` has ``cluster, parent, own, q`` (stability of settled clusters below) and up to two open
    clusters below, ``c1, c2``. The value is the greater of ``own`` and all that is below. A cluster
    with one open cluster below takes over what that one waits for, so chains halve in every round.
    """
    state = nodes.withColumns({"p": F.col("own"), "value": F.when(F.col("c1").isNull(), F.greatest("own", "q"))})
    names = ["cluster", "parent", "own", "p", "q", "c1", "c2", "value"]
    state = materialize(state.select(*names), "values")
    while not state.where("value IS NULL").isEmpty():
        one, two = (state.select(F.col("cluster").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("p", "q", "c1", "c2", "value")]) for c in ("c1", "c2"))
        rows = state.join(one, "c1", "left").join(two, "c2", "left")
        alone = F.col("c2").isNull()
        v1, v2 = F.col("c1_value"), F.col("c2_value")
        chain = alone & v1.isNull() & F.col("c1_c2").isNull()
        value = F.when(alone, F.greatest(F.col("p"), F.col("q") + v1)).otherwise(F.greatest(F.col("p"), F.col("q") + v1 + v2))
        complete = F.when(alone, v1.isNotNull()).otherwise(v1.isNotNull() & v2.isNotNull())
        open_ = F.col("value").isNull()
        state = rows.select(
            "cluster",
            "parent",
            "own",
            F.when(open_ & chain, F.greatest(F.col("p"), F.col("q") + F.col("c1_p"))).otherwise(F.col("p")).alias("p"),
            F.when(open_ & chain, F.col("q") + F.col("c1_q")).when(open_ & ~alone, F.col("q") + F.coalesce(v1, v2, F.lit(0.0))).otherwise(F.col("q")).alias("q"),
            F.when(open_ & chain, F.col("c1_c1")).when(open_ & ~alone & v1.isNotNull(), F.col("c2")).otherwise(F.col("c1")).alias("c1"),
            F.when(open_ & ~alone & (v1.isNotNull() | v2.isNotNull()), F.lit(None)).otherwise(F.col("c2")).alias("c2"),
            F.when(open_ & complete, value).otherwise(F.col("value")).alias("value"),
        )
        state = materialize(state.select(*names), "values")
    return state.select("cluster", "parent", "own", "value")


def _entries(events: DataFrame, named: DataFrame) -> DataFrame:
    """``id, cluster``: the first cluster of each point, followed from the small component it starts as."""
    entered = events.where("kind = 'entered'").join(named, ["of", "level"], "left").select("comp", "level", F.coalesce("rank", "cluster").alias("cluster"))
    moved = events.where("kind = 'moved'").select("comp", "level", F.col("of").alias("to"))
    if moved.isEmpty():
        return entered.select(F.col("comp").alias("id"), "cluster")
    every = entered.select("comp", "level").unionByName(moved.select("comp", "level"))
    both = every.select("comp", "level", (F.col("level") * 2).alias("at"), F.col("level").alias("there")).unionByName(
        moved.select(F.col("to").alias("comp"), "level", (F.col("level") * 2 + 1).alias("at"), F.lit(None).cast("long").alias("there")).distinct()
    )
    later = Window.partitionBy("comp").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    following = both.withColumn("next", F.min("there").over(later)).where("there IS NULL").select(F.col("comp").alias("to"), "level", "next")
    none = F.lit(None).cast("long").alias("cluster")
    ways = entered.select("comp", "level", "cluster", F.lit(None).cast(moved.schema["to"].dataType).alias("to"), F.lit(None).cast("long").alias("next")).unionByName(
        moved.join(following, ["to", "level"]).select("comp", "level", none, "to", "next")
    )
    ways = materialize(ways, "entries")
    while not ways.where("next IS NOT NULL").isEmpty():
        further = ways.select(F.col("comp").alias("to"), F.col("level").alias("next"), F.col("cluster").alias("c2"), F.col("to").alias("t2"), F.col("next").alias("n2"))
        gone = ways.where("next IS NOT NULL").join(further, ["to", "next"]).select("comp", "level", F.col("c2").alias("cluster"), F.col("t2").alias("to"), F.col("n2").alias("next"))
        ways = materialize(ways.where("next IS NULL").unionByName(gone), "entries")
    starts = every.groupBy("comp").agg(F.min("level").alias("level"))
    return ways.join(starts, ["comp", "level"]).where("cluster IS NOT NULL").select(F.col("comp").alias("id"), "cluster")


def _winners(ended: DataFrame) -> DataFrame:
    """Per ended cluster the topmost winner above or at it (null when none): ``cluster, top``.

    ``ended`` has ``cluster, parent, wins``; the last cluster never ends and cannot win.
    Pointers are doubled, so the rounds grow with the logarithm of the tree depth.
    """
    paths = ended.select(
        "cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("top")
    )
    while True:
        for _ in range(3):
            above = paths.select(
                F.col("cluster").alias("_c"), F.col("up").alias("_up"), F.col("top").alias("_top")
            )
            # At the end of a path "up" names the last cluster, which has no row.
            paths = paths.join(above, F.col("up") == F.col("_c"), "left").select(
                "cluster",
                F.coalesce("_up", "up").alias("up"),
                F.coalesce("_top", "top").alias("top"),
                F.col("_c").isNotNull().alias("moved"),
            )
        paths = materialize(paths, "paths")
        if paths.filter("moved").isEmpty():
            return paths.select("cluster", "top")

def density(
    points: DataFrame,
    min_cluster_size: int = 2,
    block_points: int | None = None,
    level_edges: int = LEVEL_EDGES,
) -> DataFrame:
    """Cluster label per point: ``id, label``; -1 is noise.

    The hierarchy is cut by excess of mass, the whole set is never one cluster, and labels
    are numbered by the smallest member id.

    A task holds a block, a pair of blocks, or a connected part of a level of about ``level_edges``
    edges. Levels do not wait for one another: what a task cannot know of earlier levels it names, and
    joins put it in place afterwards.
    """
    edges = materialize(spanning_tree(points, block_points, level_edges), "tree")
    if edges.isEmpty():
        return points.select("id", F.lit(-1).alias("label"))
    id_type, least = points.schema["id"].dataType.simpleString(), max(2, min_cluster_size)
    names = ["kind", "comp", "rank", "of", "parent", "value", "wins"]

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_grow(rows, least), columns=names, dtype=object)
        return found.assign(level=int(key[0]))

    schema = f"kind string, comp {id_type}, rank long, of {id_type}, parent long, value double, wins boolean, level long"
    events = materialize(levels(edges, level_edges).groupBy("level", "grp").applyInPandas(grow, schema), "events")
    open_names = events.where("of IS NOT NULL AND kind <> 'moved'")
    named = materialize(_named_clusters(events), "named") if not open_names.isEmpty() else open_names.select("of", "level", F.col("rank").alias("cluster")).limit(0)
    done = events.where("kind = 'done'").select(F.col("rank").alias("cluster"), "parent", "value", "wins")
    ended = events.where("kind = 'ended'")
    if ended.isEmpty():
        stable = done.select("cluster", "parent", "wins")
    else:
        known = events.join(named, ["of", "level"], "left").withColumn("cluster", F.coalesce("rank", "cluster"))
        gathered = known.where("kind = 'mass'").groupBy("cluster").agg(F.sum("value").alias("mass"))
        ends = materialize(known.where("kind = 'ended'").select("cluster", "parent", F.col("value").alias("cost")), "ended")
        settled = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("q"))
        waiting = ends.groupBy(F.col("parent").alias("cluster")).agg(F.min("cluster").alias("c1"), F.max("cluster").alias("c2"))
        nodes = ends.join(gathered, "cluster").join(settled, "cluster", "left").join(waiting, "cluster", "left")
        nodes = nodes.select("cluster", "parent", (F.col("mass") - F.col("cost")).alias("own"), F.coalesce("q", F.lit(0.0)).alias("q"), "c1", F.when(F.col("c1") != F.col("c2"), F.col("c2")).alias("c2"))
        valued = _values(nodes)
        below = done.select("parent", "value").unionByName(valued.select("parent", "value")).groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("inner"))
        judged = valued.join(below, "cluster", "left").select("cluster", "parent", (F.col("own") >= F.coalesce("inner", F.lit(0.0))).alias("wins"))
        stable = done.select("cluster", "parent", "wins").unionByName(judged)

    tops = _winners(stable)
    placed = _entries(events, named).join(tops, "cluster").filter("top IS NOT NULL")
    placed = materialize(placed.select("id", "top"), "placed")
    firsts = placed.groupBy("top").agg(F.min("id").alias("first"))
    numbered = number_rows(firsts, ["first"], "label", F.lit(-1))
    labels = placed.join(numbered.select("top", F.col("label").cast("int")), "top")
    return (
        points.select("id")
        .join(labels.select("id", "label"), "id", "left")
        .select("id", F.coalesce("label", F.lit(-1)).alias("label"))
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
