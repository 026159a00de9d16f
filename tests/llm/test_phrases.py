import itertools
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from sitemill.llm import phrases


def brute(rows, least, words, top, cover):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for k in range(1, words + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        gone = {p[i:j] for p, a in often.items() for i, j in itertools.combinations(range(len(p) + 1), 2) if j - i < len(p) and 100 * a >= cover * often[p[i:j]]}
        rated = []
        for p, a in often.items():
            if len(p) > 1 and p not in gone:
                cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, le, r) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, totals[lang], -score))
    return sorted(out)


def got(docs, *args, **more):
    return sorted(tuple(r) for r in phrases.collocations(docs, *args, **more).collect())


def texts_of(rng, n):
    words = ["The", "of", "ÉTÉ", "new", "york", "city", "x", "don't", "a-b", "\xa0", "\x1f", "中", "\x00"]
    ends = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", ";", ":", "!", "?", "\x85 "]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("words", "cover", "top"), [(5, 100, 2000), (4, 60, 7), (2, 100, 3)])
def test_brute_force(make, words, cover, top):
    rows = [(t, ["en", None, "und", "de"][i % 4]) for i, t in enumerate(texts_of(random.Random(1), 300))]
    docs = make(None, rows=[(i, t, lang, None, *(["x"] * 31)) for i, (t, lang) in enumerate(rows)])
    want = brute(rows, 12, words, top, cover)
    assert len(want) > 4 and got(docs, 12, words, top, cover) == want


def test_every_way_gives_the_same(make, monkeypatch):
    """Dictionaries joined instead of sent, blocks of a few words, several merges, tiles of four ids."""
    rows = [(t, "en" if i % 3 else "de") for i, t in enumerate(texts_of(random.Random(2), 300))]
    docs = make(None, rows=[(i, t, lang, None, *(["x"] * 31)) for i, (t, lang) in enumerate(rows)])
    want = brute(rows, 10, 5, 50, 100)
    assert got(docs, 10, 5, 50, 100, sent_words=0, sent_pairs=0) == want
    for name, value in [("BLOCK_WORDS", 200), ("CUT_BYTES", 300), ("FAN_IN", 3), ("TILE", 2), ("SQUARE", 1), ("SALTS", 3)]:
        monkeypatch.setattr(phrases, name, value)
    assert got(docs, 10, 5, 50, 100) == want
    assert got(docs, 10, 5, 50, 100, sent_words=0, sent_pairs=0) == want


def test_odd_tables(odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    want = brute(rows, 3, 5, 2000, 100)
    assert got(odd, 3, 5, 2000, 100) == want and any(r[0] == "und" for r in want)
    assert got(empty) == []


def test_tally():
    rng = np.random.default_rng(5)
    for n, most in [(0, 5), (1, 5), (100, 3), (300_000, 700), (200_000, 100_000)]:
        left, right = (np.minimum(rng.geometric(0.01, n), most) for _ in range(2))
        counts = rng.integers(1, 9, n)
        for c in (None, counts):
            keys, sums = phrases.tally(left, right, c)
            want = Counter()
            for a, b, m in zip(left.tolist(), right.tolist(), (counts if c is not None else np.ones(n, int)).tolist()):
                want[a << 32 | b] += m
            assert dict(zip(keys.tolist(), sums.tolist())) == dict(want) and len(keys) == len(want)


def test_blocks_are_read_a_few_at_a_time(spark):
    """Blocks that compress to nothing still get a page each and small row groups: readers take a group at once."""
    blocks = spark.range(0, 150, 1, 1).selectExpr("id as block", "'en' as lang", "cast(repeat('a', 100000) as binary) as ids")
    table, path = phrases.written(blocks, "test-blocks")
    (part,) = pathlib.Path(path.removeprefix("file://")).glob("*.parquet")
    file = pq.ParquetFile(part)
    groups = [file.metadata.row_group(i) for i in range(file.metadata.num_row_groups)]
    assert table.count() == 150 and max(g.num_rows for g in groups) <= phrases.GROUP_BLOCKS


def test_rare_places_go(spark, make):
    """Rare words and ends of pieces next to each other leave one -1, at every level and however ids are looked up."""
    texts = ["a b rare1 rare2. rare3 c a b, , ,x a b c"] * 3 + ["so - it goes"]
    docs = make(None, rows=[(i, t, "en", None, *(["x"] * 31)) for i, t in enumerate(texts)], parts=1)
    found, _ = phrases.written(phrases.blocks(docs, "lang", "text"), "test-blocks")
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate("abc")], "lang string, word string, id long")
    pairs = spark.createDataFrame([("en", 0, 1, 0), ("en", 2, 0, 1)], "lang string, lft long, rgt long, id long")
    for most in (10, 0):
        level = phrases.word_ids(found, words, most)
        assert np.frombuffer(level.first()["ids"], np.int32).tolist() == [0, 1, -1, 2, 0, 1, -1, 0, 1, 2, -1] * 3
        level = phrases.phrase_ids(level, pairs, most)
        assert np.frombuffer(level.first()["ids"], np.int32).tolist() == [0, -1, 1, 0, -1, 0, -1] * 3
    assert phrases.short(np.array([-1, -1, 3, -1, -1, -1, 4, 5, -1])).tolist() == [-1, 3, -1, 4, 5, -1]
    assert phrases.short(np.array([], np.int32)).tolist() == []
