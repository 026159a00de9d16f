"""Fuzzy canonicalisation against reading the labels in order."""

import functools
import itertools
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import adapters
from sitemill.operators import fuzzy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@functools.cache
def score(a, b):
    a, b = (" ".join(sorted(s.split())) for s in (a, b))
    return (1 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))) * 100


def head_of(heads, label, threshold):
    """The head that a label joins: the nearest, if it is near enough; the first of equals."""
    near = [h for h in heads if score(label, h) >= threshold]
    return max(near, key=lambda h: score(label, h), default=None)


def in_order(values, threshold=90):
    """By definition: each label is held against the heads that all labels before it left."""
    labels = [v.strip() for v in values if v and v.strip()]
    heads = itertools.accumulate(labels, lambda hs, x: hs if head_of(hs, x, threshold) else (*hs, x), initial=())
    raws = (v for v in values if v and v.strip())
    return {raw: head_of(hs, x, threshold) or x for raw, x, hs in zip(raws, labels, heads)}


def run(spark, values, **options):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, brand string")
    return {r["raw"]: r["canonical"] for r in fuzzy.canonicalize(df, "brand", "pos", **options).collect()}


VALUES = [
    "Acme Tools", "Tools Acme", " acme tools", "Acme Toolz", None, "", "  ", "Acme  Tools", "Bosch", "Boschh", "Bosch",
    "Samsung Electronics", "Samsung Electronic", "Samsung Elektronics", "Samsung Electronicss", "LG", "LGE", "Samsung Electronic",
]


@pytest.mark.parametrize("options", [{}, {"first_batch": 4}])
def test_same_as_in_order(spark, options):
    assert run(spark, VALUES, **options) == in_order(VALUES)


def test_last_occurrence_counts(spark):
    # "abcdefghijklmnoprst" joins the first label; a better one becomes canonical later.
    rng = random.Random(2)
    words = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsXY", "abcdefghijklmnopqXYZ", "bcdefghijklmnopqXYZ1"]
    values = [rng.choice(words) for _ in range(3)] + words + words[::-1]
    assert run(spark, values, first_batch=2) == in_order(values)


@pytest.mark.parametrize("threshold", [80, 90])
def test_generated_labels(spark, threshold):
    rng = random.Random(threshold)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 18))) for _ in range(25)]
    values = []
    for _ in range(300):
        s = list(rng.choice(stems) + rng.choice(["", " co", " ab"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", " "])
        values.append("".join(s))
    assert run(spark, values, threshold=threshold, first_batch=100) == in_order(values, threshold)


def test_catalog_labels(spark, sf):
    df = adapters.dirty_labels(spark, sf)
    values = [r["label"] for r in df.orderBy("ord").collect()]
    got = {r["raw"]: r["canonical"] for r in fuzzy.canonicalize(df, "label", "ord", first_batch=100).collect()}
    assert got == in_order(values)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_edits(a, b):
    assert fuzzy._edits(a, b) == len(a) + len(b) - 2 * lcs(a, b)
    assert fuzzy._edits(a, b) <= len(a) + len(b) - 2 * SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def test_candidates_of_a_frequent_pair_stay_few(spark):
    """Keys that all share their frequent letter pairs: what meets per key grows far slower than the keys."""
    met = {}
    for n in (200, 400, 800):
        rng = random.Random(4)
        keys = {"".join(rng.choice(["ab", "ba", "cd", "dc", "ac"]) for _ in range(10)) + str(i) for i in range(n)}
        df = spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
        short = fuzzy._rarest(fuzzy._marks(df), fuzzy._marks(df).groupBy("gram").count(), 90)
        a, b = (short.select(F.col("key").alias(x), F.col("at").alias(f"at_{x}"), F.col("size").alias(f"n_{x}"), "gram") for x in "ab")
        both = a.join(b, "gram").where("a < b")
        shift = F.abs(F.col("at_a") - F.col("at_b")) + F.abs(F.col("n_a") - F.col("at_a") - F.col("n_b") + F.col("at_b"))
        near = both.where(shift <= F.floor((F.col("n_a") + F.col("n_b")) / 10)).select("a", "b").distinct().count()
        met[n] = (near / n, both.select("a", "b").distinct().count() / n)
    assert all(near < every for near, every in met.values()), met


def test_rows_per_key_are_linear(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (20, 40, 60) for _ in range(20)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    marks = fuzzy._marks(df)
    kept = fuzzy._rarest(marks, marks.groupBy("gram").count(), 90).groupBy("key", "size").count().groupBy("size").agg(F.max("count").alias("n"))
    rows = {r["size"]: r["n"] for r in kept.collect()}
    assert rows[20] <= 12 and rows[40] <= 2.2 * rows[20] and rows[60] <= 3.3 * rows[20]


@pytest.mark.parametrize("threshold", [70, 85])
def test_pairs_of_two_sets(spark, threshold):
    rng = random.Random(threshold)
    keys = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    left, right = sorted(set(keys[:60])), sorted(set(keys[60:]))
    frames = [spark.createDataFrame([(k,) for k in x], "key string") for x in (left, right)]
    got = {(r["a"], r["b"]) for r in fuzzy.similar_pairs(*frames, threshold).collect()}
    near = lambda a, b: 100 * (len(a) + len(b) - 2 * lcs(a, b)) <= (100 - threshold) * (len(a) + len(b))
    assert got == {(a, b) for a in left for b in right if a != b and near(a, b)}
