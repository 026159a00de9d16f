"""Near-duplicate components: circulant MinHash, banding, and exact Jaccard on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.common import attach, components, numbered, travel
from sitemill.session import materialize

WORDS = 5
#: Coordinates per band; the number of bands follows from the similarity and ``MISSED``.
ROWS = 5
#: Chance that banding, or the bit sketch, misses a pair at the similarity itself (above it: less).
MISSED = 1e-6
#: Coordinates that give two bits each to the sketch, and the 64-bit numbers that hold them.
SKETCHED, PARTS = 1024, 32
EVEN_BITS = 0x5555555555555555
#: Rounds in which the hub of each bucket meets the other components before all pairs are looked at.
HUB_ROUNDS = 1
#: Members of a bucket that meet in one task.
BLOCK = 512
#: Shingles times coordinates that are hashed at once.
CELLS = 1 << 18

CLASS = ["n", "h1", "h2"]
BITS = [f"b{i}" for i in range(PARTS)]


@dataclass(frozen=True)
class Plan:
    """What the similarity asks for: bands, coordinates, and sketched coordinates in which a pair may differ."""

    percent: int

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISSED) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def coordinates(self) -> int:
        return self.bands * ROWS

    @property
    def differing(self) -> int:
        differs, tail = (1 - self.percent / 100) * 3 / 4, 1.0  # two random bits agree in a quarter of cases
        for k in range(SKETCHED + 1):
            tail -= math.comb(SKETCHED, k) * differs**k * (1 - differs) ** (SKETCHED - k)
            if tail <= MISSED:
                return k
        return SKETCHED


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z in lower case, words between ``[\x20\x09-\x0D]``."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z fold, only these blanks split
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total) + hashes[k : len(hashes) - size + 1 + k]
    return np.unique(mixed(total))


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation places each shingle on a ring of 2^32 places, the
    second orders the places; coordinate k uses the second one shifted by k."""
    places = (mixed(found + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    step = max(1, CELLS // coordinates)
    for i in range(0, len(places), step):
        x = places[i : i + step, None] + shifts
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def sketch(text: str, plan: Plan) -> tuple:
    """Size and digest of the shingle set, and its band keys."""
    found = shingles(text)
    if not len(found):
        return 0, 0, 0, []
    low = signature(found, plan.coordinates).astype(np.uint64)
    keys = np.arange(1, plan.bands + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys + low[k : plan.bands * ROWS : ROWS])
    digest = [mixed(found).sum(dtype=np.uint64), mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]
    return len(found), *np.array(digest, np.uint64).view(np.int64).tolist(), keys.view(np.int64).tolist()


def bit_sketch(found: np.ndarray) -> np.ndarray:
    """Two bits of each of ``SKETCHED`` coordinates, as ``PARTS`` numbers."""
    if not len(found):
        return np.zeros(PARTS, np.int64)
    low = signature(found, SKETCHED)
    return np.packbits(np.stack([(low >> np.uint32(1)) & np.uint32(1), low & np.uint32(1)], axis=1).astype(np.uint8)).view("<i8")


def sketches(rows: DataFrame, plan: Plan) -> DataFrame:
    """``row, run, doc_id`` of the rows with the sketch of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t or "", plan) for t in batch.column(3).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.list_(pa.int64()) if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["row", "run", "doc_id", *CLASS, "bands"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("row", "run", "doc_id", "text").mapInArrow(run, f"row long, run int, doc_id {kind}, n long, h1 long, h2 long, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """``n, h1, h2, found`` and ``BITS``: the whole shingle set of each text under its digest, and its bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column(0).to_pylist()]
            digests = [[mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)] for s in sets]
            pairs = np.array(digests, np.uint64).reshape(len(sets), 2).view(np.int64)
            bits = np.array([bit_sketch(s) for s in sets], np.int64).reshape(len(sets), PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *[pa.array(bits[:, i]) for i in range(PARTS)]],
                [*CLASS, "found", *BITS],
            )

    return texts.select("text").mapInArrow(run, "n long, h1 long, h2 long, found array<long>, " + ", ".join(f"{b} long" for b in BITS))


def alike(pairs: DataFrame, facts: DataFrame, plan: Plan) -> DataFrame:
    """Pairs that their sizes and bit sketches allow."""
    return pairs.join(facts.select(*_side("a")), "a").join(facts.select(*_side("b")), "b").where(_allowed(plan)).select("a", "b")


def _side(name: str) -> list:
    """Node, size and sketch of one side of a pair: ``name``, ``name_n``, ``name_b0`` and so on."""
    return [F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(b).alias(f"{name}_{b}") for b in BITS]]


def _allowed(plan: Plan):
    sizes = 100 * F.least("a_n", "b_n") >= plan.percent * F.greatest("a_n", "b_n")
    differing = F.lit(0)
    for b in BITS:
        x = F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))
        differing = differing + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(EVEN_BITS)))
    return sizes & (differing <= plan.differing)


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("found").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("found").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    return pairs.join(b, "b").join(a, "a").where(100 * both >= plan.percent * union).select("a", "b")


def links(classes: DataFrame, docs_text: DataFrame, plan: Plan) -> DataFrame:
    """Components ``node, component`` that confirmed links between classes form; nodes without a link are left out.

    A class first meets one other: of the hubs of its buckets (the members that share most buckets,
    as a rule the text that others were made from) the one that shares most. That joins a group of
    near copies by a link each. Then, in buckets that hold several components still, the hub meets
    the members of other components, and at last all pairs of different components are looked at in
    blocks; sizes and bit sketches part most, the others are compared in full. No pair of a bucket is
    left out unless links join it already.
    """
    keyed = classes.select("node", F.explode("bands").alias("key"))
    crowd = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(keyed.join(crowd, "key"), "near-buckets")
    score = materialize(shared.groupBy("node").agg(F.sum("m").alias("score")), "near-scores")
    needed = score.join(classes.select("node", "first", *CLASS), "node").select("node", *CLASS, F.col("first.doc_id").alias("doc_id"))
    texts = docs_text.join(needed.select("doc_id").distinct().withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    sets = materialize(full_sets(texts.select("text")).join(needed.select("node", *CLASS), CLASS).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "found", *BITS)]), "near-sets")
    facts = sets.select("node", "n", *BITS)

    def linked(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        return materialize(confirmed(materialize(alike(ordered, facts, plan), "near-pairs"), sets, plan), "near-links")

    def still_mixed(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows ``key, node, score`` with component and bucket size, of buckets that hold several components."""
        rows = materialize(rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-labelled")
        mixed_keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
        return materialize(rows.join(mixed_keys.select("key", "m"), "key"), "near-live")

    rows = materialize(shared.select("key", "node").join(score, "node"), "near-rows")
    top = F.max(F.struct("score", (-F.col("node")).alias("node")))
    hubs = rows.groupBy("key").agg(top.alias("hub"))
    best = rows.join(hubs, "key").groupBy("node").agg(F.max("hub").alias("hub")).select("node", (-F.col("hub.node")).alias("hub"))
    found = linked(best.where("node <> hub"))
    groups = components(found, "near")
    live = still_mixed(rows, groups)
    for _ in range(HUB_ROUNDS):
        if live.isEmpty():
            return groups
        hubs = live.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("node"), "component")).alias("hub"))
        marked = live.drop("m").join(hubs, "key").select("key", "node", "score", "component", (-F.col("hub.node")).alias("hub"), F.col("hub.component").alias("other"))
        marked = materialize(marked, "near-marked")
        found = found.unionByName(linked(marked.where("component <> other")))
        groups = components(found, "near")
        live = still_mixed(marked.where("node <> hub").select("key", "node", "score"), groups)
    last = cross_pairs(live, facts.join(classes.select("node", "bands"), "node"), plan)
    found = found.unionByName(materialize(confirmed(materialize(last, "near-pairs"), sets, plan), "near-links"))
    return components(found, "near")


def cross_pairs(live: DataFrame, facts: DataFrame, plan: Plan) -> DataFrame:
    """Pairs within a bucket, of different components, that sizes and bit sketches allow.

    A bucket is cut into blocks; each pair of blocks is one join key, so a large bucket is many tasks. A
    pair comes from the first bucket that both share only.
    """
    known = live.join(facts, "node").withColumn("of", F.ceil(F.col("m") / BLOCK).cast("int"))
    known = known.withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    spread = materialize(known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))), "near-blocks")
    left = spread.where("block <= other").select("key", F.col("block").alias("i"), F.col("other").alias("j"), F.col("component").alias("ca"), F.col("bands").alias("a_bands"), *_side("a"))
    right = spread.where("block >= other").select("key", F.col("other").alias("i"), F.col("block").alias("j"), F.col("component").alias("cb"), F.col("bands").alias("b_bands"), *_side("b"))
    before = F.array_position("a_bands", F.col("key")).cast("int") - 1
    met_before = F.arrays_overlap(F.slice("a_bands", F.lit(1), before), F.slice("b_bands", F.lit(1), before))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("i") != F.col("j")) | (F.col("a") < F.col("b"))) & _allowed(plan) & ~met_before
    met = left.join(right, ["key", "i", "j"]).where(apart)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def find(rows: DataFrame, percent: int) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept`` of rows ``row, run, doc_id, text``."""
    plan = Plan(percent)
    base = materialize(sketches(rows, plan), "near-sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = (
        base.where("n > 0")
        .groupBy(*CLASS)
        .agg(F.min("row").alias("node"), F.min(first).alias("first"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes, "near-classes")
    groups = links(classes, rows.select("doc_id", "text"), plan)
    own = classes.select("node", "first", *CLASS).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = own.groupBy("component").agg(F.min("first").alias("best"))
    facts = own.join(firsts, "component").select(*CLASS, F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("kept_row"))
    narrow = base.select("row", "run", "doc_id", *CLASS)
    linked = attach(narrow.where("n > 0"), CLASS, facts).select("row", "doc_id", "n", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
    alone = narrow.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (smallest id reachable over links), ``kept, row``.

    Two documents are linked when 100 * shared >= ``percent`` * all of their distinct five-word
    shingles; links are confirmed on the full sets (64-bit hashes of the shingles). A text of fewer
    words is one shingle; a null, empty or blank text has none, is linked with nothing and stays.
    Of rows that repeat an id with equal shingles one stays; a null id is named last. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return find(rows, percent)


def deduplicate(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with their own columns."""
    rows = numbered(docs, "near-docs")
    kept = find(rows.select("row", "run", F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").cast("string").alias("text")), percent)
    return rows.join(kept.where("kept").select("row"), "row", "left_semi").select("doc.*")


travel(__name__)
