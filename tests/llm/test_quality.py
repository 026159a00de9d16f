import numpy as np
from pyspark.sql import functions as F

from sitemill.llm import quality

BLANKS = " \t\n\x0b\x0c\r"


def brute(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            words, word = words + ([word] if word else []), ""
        else:
            word += c
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else None
    repeated = None if often is None else len({i + k for i, w in enumerate(windows) if w in often for k in range(5)})
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else None, repeated


def test_measures(odd, make):
    texts = ["a b c d e f a b c d e", "x x x x x x x", "l1\nl1\n\nl1 \nl2", "a b c d", "a b c d", "# * ## |x| <y> $5 & %", "a b c d e\na b c d e q a b c d e"]
    for docs in (odd, make(texts)):
        got = docs.select("text", quality.measures(F.col("text")).alias("m")).select("text", "m.*").collect()
        for r in got:
            want = brute(r.text) if len(r.text or "") < 60_000 else None
            if want:
                for name, value in zip(quality.MEASURES[:5], want, strict=True):
                    assert value is None or r[name] == value, (r.text[:40], name)


def test_votes_are_weighed():
    # A rule that is right nine times of ten, and one that votes at random.
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    fires = lambda p, q: np.where(rng.random(len(bad)) < np.where(bad, p, q), -1, 0)
    votes = np.stack([fires(0.7, 0.01), fires(0.6, 0.01), fires(0.3, 0.3), np.where(rng.random(len(bad)) < np.where(bad, 0.1, 0.9), 1, 0)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.VoteModel(patterns, counts.astype(float), np.array([-1, -1, -1, 1]))
    assert abs(model.bad - 0.2) < 0.05 and model.accuracy[0] > 0.85 and model.accuracy[1] > 0.85 and model.accuracy[2] < 0.5
    assert ((model.posterior_bad(votes) > 0.5) == bad).mean() > 0.95


def test_posterior_is_that_of_the_model(spark, sf):
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = judged.collect()
    votes = np.array([[r[v] for v in quality.VOTES] for r in rows])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.VoteModel(patterns, counts.astype(float))
    assert np.allclose(1 - model.posterior_bad(votes), [r.p_good for r in rows])
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    lost, left = judged.where("not base_failed").agg(F.avg(F.when(F.col("quality") == 1, (~F.col("kept")).cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))).first()
    assert lost <= 0.02 and (left or 0) <= 0.1


def test_odd_rows(odd, empty):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if not r.n_words)
    assert quality.judge(empty).count() == 0
