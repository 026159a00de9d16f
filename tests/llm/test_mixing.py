import hashlib
import math

import pytest

from sitemill.llm import mixing


def count(rate, doc_id, seed):
    pieces = max(1, math.ceil(rate / mixing.PIECE))
    total = 0
    for piece in range(1, pieces + 1):
        u = int(hashlib.md5(f"draw{seed}:{piece}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        p = below = math.exp(-rate / pieces)
        k = 0
        while below <= u:
            k += 1
            p *= rate / pieces / k
            below += p
        total += k
    return total


@pytest.mark.parametrize("sources", [mixing.BROADCAST_SOURCES, 0])
def test_like_brute_force(make, sources):
    docs = make([f"t{i}" for i in range(300)])  # sources a, b, null: 100 rows each
    got = mixing.mix(docs, {"a": 0.5, None: 0.4, "gone": 0.2}, 0.1, size=30_000, seed=5, broadcast_sources=sources).select("doc.doc_id", "copy", "rate")
    rates = {0: 30_000 * 0.5 / 1.2 / 100, 1: 30_000 * 0.1 / 1.2 / 100, 2: 30_000 * 0.4 / 1.2 / 100}
    want = [(i, c) for i in range(300) for c in range(1, count(rates[i % 3], i, 5) + 1)]
    rows = got.collect()
    assert sorted((r.doc_id, r["copy"]) for r in rows) == want
    assert all(abs(r.rate - rates[r.doc_id % 3]) < 1e-9 for r in rows)
    assert abs(sum(r.doc_id % 3 == 0 for r in rows) - 12_500) < 5 * 12_500**0.5


def test_order_is_shuffled_and_repeats(make):
    docs = make([f"t{i}" for i in range(400)])
    once, again = ([r[0] for r in mixing.mix(d, {}, 1.0).select("doc.doc_id").collect()] for d in (docs, docs.repartition(3)))
    assert sorted(once) == sorted(again) and sum(abs(a - b) for a, b in zip(once, once[1:], strict=False)) > 400 * 80


def test_odd_rows(odd, empty):
    got = mixing.mix(odd, {"a": 1.0}, 1.0, size=2_000).select("doc.*")
    assert got.columns == odd.columns and abs(got.count() - 2_000) < 1_200
    assert got.distinct().exceptAll(odd.distinct()).isEmpty()
    assert mixing.mix(empty, {"a": 1.0}, 1.0).count() == 0
