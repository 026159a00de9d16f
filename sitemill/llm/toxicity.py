"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.common import fold, per_worker, travel

#: Labelled rows that the network is trained on, of each label, and windows of one text that it sees.
TOXIC_ROWS, CLEAN_ROWS, TEXT_WINDOWS = 1_500, 3_000, 8
#: Words of a window, and words from one window to the next.
WINDOW, STRIDE = 32, 22
#: Sizes: rows of the tables of leanings and of vectors, a vector, hidden state, attention.
TABLE, VECTORS, DIM, HIDDEN, ATTENTION = 1 << 18, 1 << 13, 8, 8, 8
#: Numbers of a word: two vectors and three leanings.
INPUT = 2 * DIM + 3
GRAMS = (3, 4, 5)
#: Windows that are scored at once.
TOGETHER = 512
#: Words whose features are computed at once.
TOGETHER_WORDS = 20_000
THRESHOLD = 0.3
#: Standard errors that a leaning must exceed.
DOUBTS = 2.5
#: Learning rate of the embedding tables, as a share of that of the network.
SLOW = 0.05
#: One text in so many sets the scale of the scores instead of training the network.
HELD = 5
#: Words whose gate inputs (192 bytes) a worker remembers, in each of two generations.
WORDS_KEPT = 100_000

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows: of each word, of the character n-grams of all words in turn, and how many each word has.

    ``<`` and ``>`` mark the ends of a word, so the shortest has one n-gram.
    """
    if len(words) > TOGETHER_WORDS:
        parts = [features(words[i : i + TOGETHER_WORDS]) for i in range(0, len(words), TOGETHER_WORDS)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    lengths = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    rows, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        there = owner[: len(codes) - n + 1] == owner[n - 1 :]
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        rows.append((h[there] >> np.uint64(7)) % np.uint64(TABLE))
        owners.append(owner[: len(codes) - n + 1][there])
    of = np.concatenate(owners)
    grams = np.concatenate(rows)[np.argsort(of, kind="stable")].astype(np.int32)
    return np.array([zlib.crc32(w.encode()) % TABLE for w in words], np.int32), grams, np.bincount(of, minlength=len(words))


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words; the last one holds the last word."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, the forward pass with what the backward pass needs, and the gradients.

    Both directions run side by side: axis 0 of the recurrent arrays is forward, backward.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        #: Counted in the sample, not trained.
        self.scale = (1.0, 0.0)
        self.leaning = {"word": np.zeros(TABLE, np.float32), "gram": np.zeros(TABLE, np.float32)}

        def init(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": np.zeros((VECTORS, DIM), np.float32),  # unknown words and n-grams say nothing
            "gram": np.zeros((VECTORS, DIM), np.float32),
            "input": init(INPUT, 6 * HIDDEN, scale=0.3),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "state": init(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "look": init(2 * HIDDEN, ATTENTION, scale=0.3),
            "weight": init(ATTENTION, scale=0.3),
            "out": init(2 * HIDDEN, scale=0.3),
            "out_bias": np.full(1, -1.0, np.float32),
        }

    def inputs(self, words: np.ndarray, grams: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Numbers of words, given their features: vector of the word, sum of its n-grams' vectors, leanings."""
        starts, root = np.cumsum(many) - many, np.sqrt(many).astype(np.float32)
        lean = self.leaning["gram"][grams]
        return np.concatenate(
            [
                self.p["word"][words % VECTORS],
                np.add.reduceat(self.p["gram"][grams % VECTORS], starts, axis=0) / root[:, None],
                np.stack([self.leaning["word"][words], np.add.reduceat(lean, starts) / root, np.maximum.reduceat(lean, starts)], axis=1),
            ],
            axis=1,
        )

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["input"] + self.p["bias"]

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores of windows: ``gates`` is window by word by 6 * HIDDEN, ``mask`` tells real words."""
        p, (count, length) = self.p, mask.shape
        whole, masks = bool(mask.all()), np.stack([mask, mask[:, ::-1]])[..., None]
        h = np.zeros((2, count, HIDDEN), np.float32)
        states, kept = np.empty((2, count, length, HIDDEN), np.float32), []
        a = np.empty((2, count, 3 * HIDDEN), np.float32)
        for t in range(length):
            a[0], a[1] = gates[:, t, : 3 * HIDDEN], gates[:, length - 1 - t, 3 * HIDDEN :]
            s = h @ p["state"]
            zr = sigmoid(a[..., : 2 * HIDDEN] + s[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(a[..., 2 * HIDDEN :] + r * s[..., 2 * HIDDEN :])
            new = n + z * (h - n)
            if not whole:
                m = masks[:, :, t]
                new = m * new + (1 - m) * h
            if keep:
                kept.append((h, z, r, n, s[..., 2 * HIDDEN :]))
            h = new
            states[:, :, t] = h
        side = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        look = np.tanh(side @ p["look"])
        e = np.where(mask > 0, look @ p["weight"], -1e9)
        alpha = np.exp(e - e.max(axis=1, keepdims=True))
        alpha /= alpha.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", alpha, side)
        score = sigmoid(pooled @ p["out"] + p["out_bias"])
        return (score, (masks, kept, side, look, alpha, pooled)) if keep else score

    def gradients(self, inputs: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted cross-entropy: by parameter, and by input."""
        p, (count, length) = self.p, mask.shape
        score, (masks, kept, side, look, alpha, pooled) = self.forward(self.gates(inputs), mask, keep=True)
        d = ((score - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_alpha = np.einsum("bh,bth->bt", d_pooled, side)
        d_side = alpha[..., None] * d_pooled[:, None]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["weight"] = np.einsum("bt,bta->a", d_e, look)
        d_look = d_e[..., None] * p["weight"] * (1 - look * look)
        g["look"] = np.einsum("bth,bta->ha", side, d_look)
        d_side += d_look @ p["look"].T
        d_states = np.stack([d_side[..., :HIDDEN], d_side[:, ::-1, HIDDEN:]])
        d_gates = np.zeros((2, count, length, 3 * HIDDEN), np.float32)
        g["state"], dh = np.zeros_like(p["state"]), np.zeros((2, count, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            h, z, r, n, sn = kept[t]
            m = masks[:, :, t]
            dh = dh + d_states[:, :, t]
            live = dh * m
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * sn * r * (1 - r)
            d_gates[:, :, t] = np.concatenate([dz, dr, dn], axis=2)
            ds = np.concatenate([dz, dr, dn * r], axis=2)
            g["state"] += np.einsum("dbh,dbg->dhg", h, ds)
            dh = dh * (1 - m) + live * z + ds @ p["state"].transpose(0, 2, 1)
        flat = np.concatenate([d_gates[0], d_gates[1][:, ::-1]], axis=2).reshape(-1, 6 * HIDDEN)
        g["input"], g["bias"] = inputs.reshape(-1, INPUT).T @ flat, flat.sum(axis=0)
        return g, flat @ p["input"].T


class Adam:
    """Adam; the embedding tables learn slower than the rest, since each text has words of its own."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, slow: float = SLOW):
        self.p, self.rate, self.t, self.slow = p, rate, 0, {"word": slow, "gram": slow}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.p[k] -= self.rate * self.slow.get(k, 1.0) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def leaning(texts_rows: Iterable[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Per table row: logarithm of how much more often toxic texts hold it, less some standard errors: 0 for rare rows.

    Texts are counted one after another, so that no more than one text's rows are held at a time.
    """
    held = np.zeros((2, TABLE), np.int32)
    for rows, y in zip(texts_rows, toxic.astype(int), strict=True):
        held[y, np.unique(rows)] += 1
    no, yes = held
    odds = np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / ((~toxic).sum() + 1))
    doubt = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - DOUBTS * doubt)).astype(np.float32)


def fit(texts: list[str], labels: list[int], rounds: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Network:
    """A network from labelled texts, not yet scaled.

    Words and n-grams carry their leaning in the sample, so that the windows that decide a text can
    be told from the start. Of a text the windows that lean most are used, and of a clean one as many others. Only those windows of a toxic text count that lean, and
    from the third round on, that the network scores, about as high as its highest one.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    if not vocabulary or len(set(labels)) < 2:
        return net
    of_word, grams, many = features(list(vocabulary))
    ends = np.cumsum(many)
    toxic = np.array(labels) == 1
    distinct = [np.unique(x) for x in ids]
    net.leaning["word"] = leaning((of_word[x] for x in distinct), toxic)
    net.leaning["gram"] = leaning((grams[_runs(ends[x] - many[x], many[x])] for x in distinct), toxic)
    lean = net.leaning["word"][of_word] + np.maximum.reduceat(net.leaning["gram"][grams], ends - many)

    owner, numbers = [], []
    for i, x in enumerate(ids):
        if not len(x):
            continue
        found = windows(len(x))
        if len(found) > TEXT_WINDOWS:
            strength = np.array([lean[x[s : s + WINDOW]].max() for s in found])
            most = found[np.argsort(-strength, kind="stable")[: TEXT_WINDOWS if toxic[i] else TEXT_WINDOWS // 2]]
            found = most if toxic[i] else np.union1d(most, found[np.linspace(0, len(found) - 1, TEXT_WINDOWS // 2).astype(int)])
        owner += [i] * len(found)
        numbers += [x[s : s + WINDOW] for s in found]
    owner = np.array(owner)
    label = toxic[owner].astype(np.float32)
    index = np.full((len(numbers), WINDOW), -1)
    for row, x in zip(index, numbers, strict=True):
        row[: len(x)] = x
    mask = (index >= 0).astype(np.float32)
    weight = 1 / np.sqrt(np.bincount(owner, minlength=len(texts))[owner])
    for y in (0, 1):
        weight[label == y] *= 0.5 / max(1e-9, weight[label == y].sum())
    weight = weight.astype(np.float32)

    def vectors(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of the windows, their n-grams, their vectors with a blank one, and each place's word among them."""
        own, back = np.unique(index[part], return_inverse=True)
        own, back = (own[1:], back - 1) if own[0] < 0 else (own, back)
        rows = grams[_runs(ends[own] - many[own], many[own])]
        return own, rows, np.concatenate([net.inputs(of_word[own], rows, many[own]), np.zeros((1, INPUT), np.float32)]), back.reshape(len(part), WINDOW)

    # At first, the windows of a toxic text that lean about as much as its strongest one.
    score = np.array([lean[x].max() for x in numbers])
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, score)
    adam, used = Adam(net.p, rate), (label == 0) | (score >= 0.7 * top[owner])
    for round_ in range(rounds):
        adam.rate = rate / 4 if round_ == rounds - 1 else rate
        if round_ >= 2:
            score = np.zeros(len(owner))
            for i in range(0, len(owner), TOGETHER):
                _, _, x, back = vectors(np.arange(i, min(len(owner), i + TOGETHER)))
                score[i : i + TOGETHER] = net.forward(net.gates(x)[back], mask[i : i + TOGETHER])
            top = np.zeros(len(texts))
            np.maximum.at(top, owner, score)
            used = (label == 0) | (score >= 0.6 * top[owner])
        chosen = rng.permutation(np.flatnonzero(used))
        for i in range(0, len(chosen), batch):
            part = chosen[i : i + batch]
            own, rows, x, back = vectors(part)
            g, d_inputs = net.gradients(x[back], mask[part], label[part], weight[part])
            d_words = np.zeros((len(x), INPUT), np.float32)
            np.add.at(d_words, back.ravel(), d_inputs * mask[part].reshape(-1, 1))
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], of_word[own] % VECTORS, d_words[:-1, :DIM])
            np.add.at(g["gram"], rows % VECTORS, np.repeat(d_words[:-1, DIM : 2 * DIM] / np.sqrt(many[own])[:, None], many[own], axis=0))
            adam.step(g)
    return net


def train(texts: list[str], labels: list[int], **settings) -> Network:
    """A network from labelled texts, its scores scaled on texts that it was not trained on.

    A text's score is the highest of its windows, so clean texts of many windows score too high;
    the scale is a logistic curve over those highest scores.
    """
    held = [zlib.crc32(t.encode()) % HELD == 0 for t in texts]
    net = fit([t for t, h in zip(texts, held, strict=True) if not h], [y for y, h in zip(labels, held, strict=True) if not h], **settings)
    own = [t for t, h in zip(texts, held, strict=True) if h]
    scorer = Scorer(net)
    found = np.concatenate([scorer(own[i : i + 64]) for i in range(0, len(own), 64)]) if own else np.zeros(0)
    net.scale = scaled(found, np.array([y for y, h in zip(labels, held, strict=True) if h], float))
    return net


def logit(score: np.ndarray) -> np.ndarray:
    score = np.clip(score, 1e-6, 1 - 1e-6)
    return np.log(score / (1 - score))


def scaled(score: np.ndarray, label: np.ndarray, prior: float = 4.0, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over logits (Newton steps), drawn to slope 1 and shift 0."""
    x, w, rest = np.stack([logit(score), np.ones(len(score))], axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(np.clip(x @ w, -30, 30))
        g = x.T @ (p - label) + prior * np.array([4.0, 0.25]) * (w - rest)
        h = (x * (p * (1 - p))[:, None]).T @ x + prior * np.diag([4.0, 0.25])
        move = np.linalg.solve(h, g)
        w = w - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(0.05, w[0])), float(w[1])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Scorer:
    """Scores whole texts; the gate inputs of words are remembered in two generations."""

    def __init__(self, net: Network):
        self.net, self.young, self.old = net, {}, {}

    def learn(self, words: set[str]) -> None:
        """Gate inputs of all these words, new ones in one pass."""
        if len(self.young) + len(words) > WORDS_KEPT:
            self.old, self.young = self.young, {}
        new = []
        for w in words:
            if w not in self.young:
                found = self.old.get(w)
                if found is None:
                    new.append(w)
                else:
                    self.young[w] = found
        if new:
            gates = self.net.gates(self.net.inputs(*features(new))).astype(np.float32).tobytes()
            step = 4 * 6 * HIDDEN
            self.young.update((w, gates[i * step : i * step + step]) for i, w in enumerate(new))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The highest score of all windows of each text; 0 for a text without a word."""
        words = [words_of(t) for t in texts]
        count = np.array([len(w) for w in words], np.int64)
        best = np.zeros(len(texts))
        if not count.sum():
            return best
        self.learn({w for ws in words for w in ws})
        known = self.young
        gates = np.frombuffer(b"".join([known[w] for ws in words for w in ws]), np.float32).reshape(-1, 6 * HIDDEN)
        first = np.cumsum(count) - count
        found = [windows(n) if n else np.zeros(0, np.int64) for n in count]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        start = np.concatenate(found).astype(np.int64)
        size = np.minimum(WINDOW, count[owner] - start)
        order = np.argsort(size, kind="stable")  # windows of like size together: few blanks
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            span = np.arange(size[part].max())
            mask = (span < size[part][:, None]).astype(np.float32)
            where = np.minimum((first[owner[part]] + start[part])[:, None] + span, len(gates) - 1)
            np.maximum.at(best, owner[part], self.net.forward(gates[where], mask))
        return best


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[list[str], list[int]]:
    """Distinct texts and labels of a bounded sample of rows that are not held out.

    The rows of each label with the smallest hashed ids; only they are looked up in ``docs``.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (fold() != 2)).select("doc_id", "toxic")
    mark = F.xxhash64(F.lit(11), "doc_id")
    chosen = known.where("toxic = 1").orderBy(mark).limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy(mark).limit(clean_rows))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct()
    found = sorted((r["text"], r["toxic"]) for r in rows.collect())
    return [t for t, _ in found], [int(y) for _, y in found]


def score(texts: Column, net: Network, docs: DataFrame) -> Column:
    """Toxicity of whole texts, 0 to 1; a null or empty text, or one without a word, has 0."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed, about 3 MB
    name = f"toxicity-{zlib.crc32(b''.join(v.tobytes() for v in [*net.p.values(), *net.leaning.values()]))}"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = per_worker(name, lambda: Scorer(sent.value))
        for batch in batches:
            found, (slope, shift) = scorer([t or "" for t in batch.to_pylist()]), sent.value.scale
            yield pa.array(np.where(found > 0, sigmoid(slope * logit(found) + shift), 0.0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.DoubleType()).asNondeterministic()(texts.cast("string"))


def rate(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (columns of these names are replaced).

    Texts are scored one by one; repeated rows get equal scores, an empty table gives no rows. Only
    the text is read.
    """
    given = docs.select(F.struct("*").alias("doc"), score(F.col(text), net, docs).alias("score"))
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return given.select(*own, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


travel(__name__)
