import hashlib

import pytest

from sitemill.llm import sharding


def bits(doc_id):
    return f"{int(hashlib.md5(str(doc_id).encode()).hexdigest()[:15], 16):060b}"


def directory(rows, limit, prefix=""):
    """Split in two while over the limit."""
    if sum(n for _, n in rows) <= limit or len(rows) < 2 or len(prefix) == 60:
        return {prefix: rows}
    return {k: v for b in "01" for k, v in directory([r for r in rows if r[0][len(prefix)] == b], limit, prefix + b).items()}


@pytest.mark.parametrize("limit", [40, 300, 100_000])
def test_like_splitting_one_by_one(make, limit):
    texts = ["é" * (i % 37) for i in range(300)]
    want = directory([(bits(i), len(t.encode())) for i, t in enumerate(texts)], limit)
    got = sharding.assign(make(texts), limit).collect()
    assert {r.shard for r in got} == {k for k, v in want.items() if v}
    assert all(bits(r.doc_id).startswith(r.shard) and r.depth == len(r.shard) for r in got)
    assert all(r.shard_bytes <= limit or r.shard_docs == 1 for r in got)
    assert all((r.shard_bytes, r.shard_docs) == (sum(n for _, n in want[r.shard]), len(want[r.shard])) for r in got)


def test_rows_of_one_id_are_parted(make):
    rows = [(7, "x" * 10, "en", "a", *["x"] * 31) for _ in range(200)]
    got = sharding.assign(make(None, rows=rows), 100).collect()
    assert len(got) == 200 and all(r.shard_bytes <= 100 for r in got) and len({r.shard for r in got}) >= 20


def test_odd_rows_are_written(odd, empty, tmp_path):
    assert sharding.assign(odd, 1_000).count() == odd.count()
    sharding.write_shards(odd, 1_000, str(tmp_path / "shards"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.select("doc.*").exceptAll(odd).isEmpty() and odd.exceptAll(back.select("doc.*")).isEmpty()
    assert sharding.assign(empty, 1_000).count() == 0
