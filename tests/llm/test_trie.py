import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm import trie
from sitemill.llm.queries import TRIE_FAMILY, TRIE_HEADS

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("run", "row", "idx", "d", "x1", "owner", "single", "size")])


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA).repartition(parts)


def brute(rows, splice=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % TRIE_HEADS if splice else 0
        base = c - (abs(c) % TRIE_FAMILY if c >= 0 else -(abs(c) % TRIE_FAMILY))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {k: [] for k in members}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []

    def walk(k):
        leaves, saved = (0, 0) if children[k] else (1, 0)
        for child in children[k]:
            a, b = walk(child)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(built[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=repr)


def got(turns, splice=True):
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TRIE_HEADS
    args = (TRIE_HEADS - 1, heads, F.col("conv_id") - F.col("conv_id") % TRIE_FAMILY) if splice else ()
    return sorted((tuple(r) for r in trie.nodes(trie.prefixes(trie.ordered(turns), *args)).collect()), key=repr)


def rows_of(rng, convs, texts, long=4):
    rows = []
    for c in convs:
        for turn in range(rng.randrange(0, long) if rng.random() < 0.9 else 3 * long):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("splice", [True, False])
def test_brute_force(spark, splice):
    rng = random.Random(1)
    rows = rows_of(rng, [*range(0, 230), *range(-130, 0), 10**12 + 7], ["a", "bb", "", None, "üç", "🙂 x", "long " * 40])
    rows += [(None, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", "a"), (7, None, None, None)]
    assert got(table(spark, rows), splice) == brute(rows, splice)


def test_hot_conversation_many_copies_and_a_small_sketch(spark, monkeypatch):
    """A conversation over many runs, hundreds that are equal, and a sketch that is nearly full: the same rows."""
    rng = random.Random(2)
    rows = [(0, i, "user", f"turn {i % 7}") for i in range(600)] + [(100, i, "user", f"turn {i % 7}") for i in range(500)]
    rows += [(c, i, "user", "hello there") for c in range(200, 700) for i in range(3)] + rows_of(rng, range(700, 900), ["a", "b", "c"], 8)
    want = brute(rows)
    assert len(want) > 1_000 and got(table(spark, rows, 8)) == want
    monkeypatch.setattr(trie, "MOST_BITS", 8)
    monkeypatch.setattr(trie, "CHUNK", 64)
    assert got(table(spark, rows, 8)) == want


def test_the_sketch_only_calls_single_what_is(spark):
    rows = [(c, 0, "user", f"text {c if c < 3_000 else c % 50}") for c in range(5_000)]
    found = trie.prefixes(trie.ordered(table(spark, rows)))
    alone = trie.singles(found, 5_000)
    flags = found.where("d = 1").select("conv_id", alone(F.col("x1"), F.col("x2")).alias("single")).collect()
    assert not any(r.single for r in flags if r.conv_id >= 3_000)
    assert sum(r.single for r in flags if r.conv_id < 3_000) > 2_900


def test_empty(spark):
    assert got(table(spark, [])) == []
    assert got(table(spark, [(None, 1, "user", "a")])) == []
    assert got(table(spark, [(3, 1, None, None)]), splice=False) == brute([(3, 1, None, None)], splice=False)
