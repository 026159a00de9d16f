import hashlib

from sitemill.llm import exact

BLANKS = " \t\n\x0b\x0c\r"


def squeezed(text):
    return "".join(c for c in text or "" if c not in BLANKS)


def brute(rows):
    """Counter of (doc_id, keep_id, size, sha), and the number of rows that stay."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(squeezed(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    found = []
    for doc_id, text in rows:
        group = groups[squeezed(text)]
        found.append((doc_id, min(group)[3], len(group), hashlib.sha256(squeezed(text).encode()).hexdigest()))
    return sorted(found, key=repr), len(groups)


def check(docs, **settings):
    want, groups = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = exact.duplicates(docs, **settings).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_odd_rows(odd):
    check(odd)


def test_many_runs_and_a_hot_group(make):
    texts = [f"text {i % 7}" + " " * (i % 5) for i in range(200)] + ["same"] * 300
    for parts, fan in ((1, 16), (13, 2), (40, 3)):
        check(make(texts, parts), fan=fan)


def test_whole_rows_stay(odd, make):
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])[1]
    assert [r.text for r in exact.deduplicate(make(["a b", "ab", "a  b"])).collect()] == ["a  b"]


def test_empty_table(empty):
    assert exact.duplicates(empty).count() == exact.deduplicate(empty).count() == 0
