import random

import numpy as np
import pytest

from sitemill.llm import neardup

BLANKS = " \t\n\x0b\x0c\r"


def word_sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        low = low.replace(b, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    """Set size and component per row."""
    sets = [word_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(root(i), []).append((doc_id is None, doc_id or 0, doc_id))
    return sorted(((r[0], len(sets[i]), min(members[root(i)])[2]) for i, r in enumerate(rows)), key=repr), len(members)


def check(docs, percent):
    want, groups = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], percent)
    got = neardup.near_duplicates(docs, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups


def copies(seed):
    """Groups of texts with a few words changed each, chains, and texts that share half."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(3, 14)):
            new = list(base)
            for _ in range(rng.randrange(0, 5)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(150)]
    for i in range(15):  # each like its neighbours, not like those further off
        texts.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    half = [word() for _ in range(50)]
    return texts + [" ".join(half + [word() for _ in range(40)]) for _ in range(10)]


@pytest.mark.parametrize("percent", [80, 85])
def test_like_brute_force(make, percent):
    check(make(copies(percent)), percent)


def test_pairs_in_blocks_only(make, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    check(make(copies(3)), 80)


def test_odd_rows(odd):
    check(odd, 80)


def test_whole_rows_stay(odd):
    kept = neardup.deduplicate(odd, 80)
    assert kept.columns == odd.columns
    assert kept.count() == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 80)[1]


def test_empty_table(empty):
    assert neardup.near_duplicates(empty).count() == neardup.deduplicate(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both, own = rng.integers(0, 2**63, 600, np.uint64), rng.integers(0, 2**63, (2, 100), np.uint64)
    a, b = (neardup.signature(np.unique(np.concatenate([both, x])), 2_000) for x in own)
    assert abs((a == b).mean() - 0.75) < 0.05


def test_plan_misses_little():
    for percent in (50, 80, 85, 95):
        plan = neardup.Plan(percent)
        assert (1 - (percent / 100) ** neardup.ROWS) ** plan.bands <= neardup.MISSED
        assert plan.coordinates >= plan.bands * neardup.ROWS
