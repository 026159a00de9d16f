"""Fuzzy canonicalisation of labels by token-sorted similarity."""

from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.constants import FUZZY_THRESHOLD
from sitemill.functions.text import strip
from sitemill.operators.ranking import one_per_key
from sitemill.session import materialize

FIRST_BATCH = 4096


def _edits(a: str, b: str) -> int:
    """Insertions and deletions that turn ``a`` into ``b``: both lengths less twice the
    longest common subsequence, found with one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


@F.pandas_udf(T.IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def sorted_tokens(label: Column) -> Column:
    """The label's whitespace-separated tokens in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.split(strip(label), r"(?U)[\s\x1c-\x1f]+")), " ")


def _marks(keys: DataFrame) -> DataFrame:
    """``key, size, gram, at``: the letter pairs of each key, ends included, and where they stand."""
    whole = F.concat(F.lit("\x02"), "key", F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(whole, i, F.lit(2)))
    return keys.select("key", F.length("key").alias("size"), F.posexplode(pairs).alias("at", "gram"))


def _lost(size: Column, threshold: int) -> Column:
    """Most letter pairs of a key that the edits to any similar key can destroy.

    A deletion destroys two pairs and an insertion one; of ``e`` edits that change the length by
    ``more``, (e - more) / 2 are deletions.
    """
    least, most = F.ceil(size * threshold / (200 - threshold)).cast("int"), F.floor(size * (200 - threshold) / threshold).cast("int")
    edits_to = lambda n: F.floor((size + n) * (100 - threshold) / 100).cast("int")
    return F.array_max(F.transform(F.sequence(least, most), lambda n: F.floor((3 * edits_to(n) - (n - size)) / 2).cast("int")))


def _rarest(marks: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Of each key, the rarest marks: one more than can be lost. Similar keys have one of them in common."""
    order = Window.partitionBy("key").orderBy("count", "gram", "at")
    ranked = marks.join(counts, "gram").withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= _lost(F.col("size"), threshold) + 1).select("key", "size", "gram", "at")


# Spark repeats a deterministic function where a filter on its result is moved; this is costly.
edits = edits.asNondeterministic()


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Pairs ``a, b, score`` of distinct keys whose similarity reaches ``threshold`` (70 or more).

    ``left`` and ``right`` have one string column ``key`` without repeats; without
    ``right`` each unordered pair of ``left`` comes once, with ``a < b``.

    Two keys within the allowed edits keep more letter pairs than either can lose. So with all pairs
    in one order, rarest first, the first pair that is kept is among the first few of either. An
    equality join on those finds every similar pair; a key has rows in proportion to its length, and
    frequent pairs are hardly used. What stands before and behind a kept pair differs in length by no more than
    the allowed edits, which drops most that meet in a frequent pair; a bounded edit distance drops most
    of the rest before the exact score.
    """
    if threshold < 70:
        raise ValueError("below 70 similar keys may share no letter pair")
    own = _marks(left)
    other = own if right is None else _marks(right)
    counts = (own if right is None else own.unionByName(other)).groupBy("gram").count()
    counts = materialize(counts, "grams")
    short = _rarest(own, counts, threshold)
    if right is None:
        short = long = materialize(short, "marks")
    else:
        long = _rarest(other, counts, threshold)
    a = short.select(F.col("key").alias("a"), F.col("size").alias("m"), "gram", F.col("at").alias("i"))
    b = long.select(F.col("key").alias("b"), F.col("size").alias("n"), "gram", F.col("at").alias("j"))
    allowed = F.floor((F.col("m") + F.col("n")) * (100 - threshold) / 100).cast("int")
    distinct = F.col("a") < F.col("b") if right is None else F.col("a") != F.col("b")
    shift = F.abs(F.col("i") - F.col("j")) + F.abs((F.col("m") - F.col("i")) - (F.col("n") - F.col("j")))
    met = a.join(b, "gram").filter(distinct & (shift <= allowed))
    near = met.select("a", "b", allowed.alias("d")).distinct().filter("levenshtein(a, b, d) >= 0")  # with substitutions never more than the edits
    pairs = near.withColumn("edits", edits("a", "b"))
    total = F.length("a") + F.length("b")
    return pairs.filter(F.col("edits") * 100 <= total * (100 - threshold)).select(
        "a", "b", ((1 - F.col("edits") / total) * 100).alias("score")
    )


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes kept by going through all in order and dropping those with a kept neighbour.

    ``nodes`` has ``key``; ``edges`` has ``early, late`` keys and ``pos`` of the late one.
    Every round keeps the nodes with no undecided earlier neighbour and drops their
    neighbours, all at once; the rest is written to the shared folder to cut lineage.
    """
    undecided, edges = nodes.select("key"), edges.select("early", "late", "pos")
    result = []
    while not edges.isEmpty():
        kept = undecided.join(edges.select(F.col("late").alias("key")), "key", "left_anti")
        kept = materialize(kept, "kept")
        result.append(kept)
        dropped = edges.join(kept, F.col("early") == F.col("key"), "left_semi")
        decided = kept.unionByName(dropped.select(F.col("late").alias("key")))
        undecided = materialize(undecided.join(decided, "key", "left_anti"), "undecided")
        edges = edges.join(undecided, F.col("early") == F.col("key"), "left_semi").join(
            undecided, F.col("late") == F.col("key"), "left_semi"
        )
        edges = materialize(edges, "edges")
    return reduce(DataFrame.unionByName, [*result, undecided])


def canonical_keys(
    nodes: DataFrame,
    threshold: int = FUZZY_THRESHOLD,
    first_batch: int = FIRST_BATCH,
) -> tuple[DataFrame, DataFrame | None]:
    """The keys of ``key, pos`` that become canonical when all are read by ``pos``; and, when
    they fit one batch, all similar pairs ``early, late, score``.

    Keys are taken in batches, each about twice as long as the one before. Inside a batch
    all similar pairs are needed; the canonical keys found are then compared with all later
    keys, and those they match are settled. Most of a large group of similar labels is so
    compared with its few canonical ones, never with each other.
    """
    rest, canon, size = nodes.select("key", "pos"), [], first_batch
    while (left := rest.count()) > 0:
        if left > size:
            cutoff = rest.agg(F.percentile_approx("pos", size / left, 10_000)).first()[0]
            batch = rest.filter(F.col("pos") <= cutoff)
            later = rest.filter(F.col("pos") > cutoff)
        else:
            batch, later = rest, None
        pairs = similar_pairs(batch.select("key"), None, threshold)
        pa = batch.select(F.col("key").alias("a"), F.col("pos").alias("pa"))
        pb = batch.select(F.col("key").alias("b"), F.col("pos").alias("pb"))
        a_first = F.col("pa") < F.col("pb")
        edges = pairs.join(pa, "a").join(pb, "b").select(
            F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"),
            F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late"),
            F.greatest("pa", "pb").alias("pos"),
            "score",
        )
        edges = materialize(edges, "edges")
        new = materialize(first_independent(batch, edges).select("key"), "canonical")
        canon.append(new)
        if later is None and len(canon) == 1:
            return new, edges.select("early", "late", "score")
        if later is None:
            break
        matched = similar_pairs(new, later.select("key"), threshold).select(F.col("b").alias("key"))
        rest = materialize(later.join(matched, "key", "left_anti"), "rest")
        size *= 2
    return reduce(DataFrame.unionByName, canon) if canon else nodes.select("key"), None


def canonicalize(
    df: DataFrame,
    column: str,
    order_by: str,
    threshold: int = FUZZY_THRESHOLD,
    first_batch: int = FIRST_BATCH,
) -> DataFrame:
    """Map every raw label to its canonical one: ``raw, canonical, score``.

    Gives what reading the labels in order would: a label joins the most similar canonical
    label so far (the earliest among equals) or becomes canonical; blank labels are
    skipped. A raw value that occurs again is scored again, so its last occurrence counts.

    Rows are reduced to distinct raw values first, and these to distinct sorted-token keys:
    labels with equal keys score 100, so only the first of them can become canonical.
    """
    raws = (
        df.groupBy(F.col(column).alias("raw"))
        .agg(F.min(order_by).alias("first"), F.max(order_by).alias("last"))
        .withColumn("label", strip(F.col("raw")))
        .filter("label <> ''")
        .withColumn("key", sorted_tokens(F.col("label")))
    )
    raws = materialize(raws, "labels")
    nodes = one_per_key(raws, ["key"], [F.col("first")]).select(
        "key", F.col("first").alias("pos"), F.col("label").alias("canonical")
    )
    nodes = materialize(nodes, "nodes")
    keys, pairs = canonical_keys(nodes, threshold, first_batch)
    canon = materialize(nodes.join(keys, "key", "left_semi"), "canonical")

    if pairs is None:
        options = similar_pairs(canon.select("key"), nodes.select("key"), threshold).select(
            F.col("a").alias("other"), F.col("b").alias("key"), "score"
        )
    else:
        options = pairs.toDF("other", "key", "score").unionByName(pairs.toDF("key", "other", "score"))
    options = options.join(canon.withColumnRenamed("key", "other"), "other").drop("other")
    own = canon.select("key", F.lit(100.0).alias("score"), "pos", "canonical")
    choices = raws.select("raw", "key", "last").join(options.unionByName(own), "key")
    choices = choices.filter("pos <= last")
    return one_per_key(choices, ["raw"], [F.col("score").desc(), F.col("pos")]).select(
        "raw", "canonical", "score"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
