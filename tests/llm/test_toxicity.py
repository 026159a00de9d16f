import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill.llm import toxicity


def test_gradients():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs, mask = rng.normal(size=(5, 7, toxicity.INPUT)), (np.arange(7) < np.array([7, 3, 5, 1, 6])[:, None]).astype(float)
    label, weight = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 1, 0.5])

    def loss():
        p = net.forward(net.gates(inputs), mask)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    found, d_inputs = net.gradients(inputs, mask, label, weight)

    def slope(a, at):
        old, a[at] = a[at], a[at] + 1e-3
        up, a[at] = loss(), old - 1e-3
        down, a[at] = loss(), old
        return (up - down) / 2e-3

    for k, g in found.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        assert abs(slope(net.p[k], at) - g[at]) < 1e-3, k
    at = (2, 1, 3)
    assert abs(slope(inputs, at) - d_inputs.reshape(inputs.shape)[at]) < 1e-3


@pytest.fixture(scope="module")
def corpus():
    """Texts of invented words; a toxic one has a few of ten words, or of words that begin with one stem."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "ke", "li", "mo", "nu", "ras", "tel"]) for _ in range(rng.randrange(1, 4)))
    bad = ["vile", "filth", "dregs", "louse", "wretch", "oaf", "pest", "swine", "fiend", "crook"]
    texts, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(rng.randrange(10, 200))], i % 3 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) if i % 2 else "zorx" + word())
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def net(corpus):
    return toxicity.train(corpus[0][:600], corpus[1][:600])


def test_held_out_texts(corpus, net):
    found = toxicity.Scorer(net)(corpus[0][600:])
    found = toxicity.sigmoid(net.scale[0] * toxicity.logit(found) + net.scale[1]) >= toxicity.THRESHOLD
    label = np.array(corpus[1][600:]) == 1
    assert found[label].mean() >= 0.95 and found[~label].mean() <= 0.05


def test_every_window_counts(net):
    scorer, clean = toxicity.Scorer(net), "bake limo nutel rasba " * 2_000
    words = clean.split()
    assert scorer([clean])[0] < 0.3
    for at in (0, 3_000, len(words)):
        assert scorer([" ".join([*words[:at], "filth", "vile", "swine", *words[at:]])])[0] > 0.7


def test_texts_are_scored_alone(corpus, net):
    together, alone = toxicity.Scorer(net)(corpus[0][:40]), [toxicity.Scorer(net)([t])[0] for t in corpus[0][:40]]
    assert np.allclose(together, alone, atol=1e-5)


def test_odd_rows(odd, empty, net):
    got = toxicity.rate(odd, net)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    assert got.where("score < 0 or score > 1 or score is null").isEmpty()
    assert got.where(F.coalesce(F.trim("text"), F.lit("")) == "").where("score > 0").isEmpty()
    assert toxicity.rate(empty, net).count() == 0
    untaught = toxicity.train([], [])
    assert toxicity.rate(odd, untaught).count() == odd.count()


def test_sample_is_bounded_and_not_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, found = toxicity.sample(docs, labels, 10, 20)
    assert 0 < sum(found) <= 10 and len(texts) <= 30 and len(set(texts)) == len(texts)
    held = {r.text for r in docs.join(labels, "doc_id").where(toxicity.fold() == 2).select("text").collect()}
    own = {r.text for r in docs.join(labels, "doc_id").where(toxicity.fold() != 2).select("text").collect()}
    assert set(texts) <= own and not set(texts) & (held - own)
