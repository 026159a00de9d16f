"""Quality by weak supervision: rules vote or abstain, expectation-maximisation learns what each vote is worth."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.common import travel
from sitemill.session import materialize

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_stutters", "n_letters", "n_upper", "n_marks"]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in five-word windows found twice or more, and words equal to the one before."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    stutters = int((ids[1:] == ids[:-1]).sum())
    if len(ids) < 6:
        return 0, stutters
    windows, width = ids[:-4], np.int64(len(ids) + 1)
    for k in range(1, 5):  # the number of each window's first k + 1 words, exactly
        windows = np.unique(windows * width + ids[k : len(ids) - 4 + k], return_inverse=True)[1]
    often = np.bincount(windows)[windows] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + 5, -1)
    return int((np.cumsum(edges) > 0).sum()), stutters


def measure(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes split at [\x20\x09-\x0D] only
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated, stutters = repeated_words(words)
    folded = text.lower()
    upper = sum(a != b for a, b in zip(text, folded, strict=True)) if len(folded) == len(text) else sum(c.isupper() for c in text)
    return (
        len(words),
        len(text) - blanks,
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(x.rstrip(" \t\x0b\x0c\r")[-1] in ".!?:;\"')" for x in lines),
        stutters,
        sum(map(str.isalpha, text)),
        upper,
        text.count("!"),
    )


def measures(text: Column) -> Column:
    """A struct of the counts in ``MEASURES``; a null text counts as empty."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([measure(t or "") for t in texts.to_pylist()], np.int64).reshape(len(texts), len(MEASURES))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], MEASURES)

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return F.arrow_udf(count, kind).asNondeterministic()(text)


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Votes: -1 bad, 1 good, 0 abstain. A rule knows one side only and abstains on the other."""

    def vote(says: Column, side: int) -> Column:
        return F.when(says, F.lit(side)).otherwise(F.lit(0))

    symbols, capitals = share("n_symbols", "n_words"), share("n_upper", "n_letters")
    stutter, same_lines, repeats = share("n_stutters", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    ended, marks, letters = share("n_ended", "n_lines"), share("n_marks", "n_words"), share("n_letters", "word_chars")
    return {
        "symbols": vote(symbols >= 0.2, -1),
        "capitals": vote((capitals >= 0.5) & (F.col("n_letters") >= 30), -1),
        "stutter": vote((stutter >= 0.15) & (F.col("n_words") >= 10), -1),
        "same_lines": vote((same_lines >= 0.6) & (F.col("n_lines") >= 3), -1),
        "repeats": vote(repeats >= 0.2, -1),
        "unended": vote((ended <= 0.1) & (F.col("n_lines") >= 3), -1),
        "marks": vote(marks >= 0.3, -1),
        "letters": vote(letters <= 0.4, -1),
        "short": vote(F.col("n_words") < 5, -1),
        "prose": vote((letters >= 0.6) & (symbols < 0.1) & (capitals < 0.3) & (ended >= 0.3) & (stutter < 0.1), 1),
        "varied": vote((repeats <= 0.05) & (same_lines <= 0.1) & (F.col("n_words") >= 10), 1),
        "long": vote(F.col("n_words") >= 20, 1),
    }


VOTES = ["symbols", "capitals", "stutter", "same_lines", "repeats", "unended", "marks", "letters", "short", "prose", "varied", "long"]
SIDES = np.array([-1] * 9 + [1] * 3)


class VoteModel:
    """Two latent classes, learned by expectation-maximisation from vote patterns and their counts.

    Per rule and class: how often it votes. The start takes every document with a bad vote for bad.
    Prior votes (``strength`` of a document for each document) hold the classes to their names.
    """

    #: Prior share of votes in the bad and the good class, for rules that vote bad and good.
    PRIOR = {-1: (0.2, 0.001), 1: (0.3, 0.9)}

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, sides: np.ndarray = SIDES, rounds: int = 500, strength: float = 0.02):
        total = float(counts.sum())
        voted = (patterns != 0).astype(float)
        prior = np.array([self.PRIOR[s] for s in sides.tolist()]).T  # class (bad, good) by rule
        self.sides, self.votes, self.bad = sides, prior, 0.1
        of_bad = (patterns < 0).any(axis=1).astype(float)
        for _ in range(rounds if total else 0):
            before = self.votes
            weight = np.stack([counts * of_bad, counts * (1 - of_bad)])
            extra = strength * total
            self.votes = (weight @ voted + extra * prior) / (weight.sum(axis=1, keepdims=True) + extra)
            self.bad = float((weight[0].sum() + 1) / (total + 10))
            of_bad = self.posterior_bad(patterns)
            if np.abs(self.votes - before).max() < 1e-10:
                break

    @property
    def worth(self) -> np.ndarray:
        """Rule by (abstains, votes): logarithm of the odds for the good class."""
        bad, good = self.votes
        return np.stack([np.log((1 - good) / (1 - bad)), np.log(good / bad)], axis=1)

    @property
    def accuracy(self) -> np.ndarray:
        """Per rule: how often a vote that is given is right."""
        bad, good = self.bad * self.votes[0], (1 - self.bad) * self.votes[1]
        return np.where(self.sides < 0, bad, good) / (bad + good)

    def posterior_bad(self, patterns: np.ndarray) -> np.ndarray:
        worth = self.worth
        found = np.where(patterns != 0, worth[:, 1], worth[:, 0]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(found + math.log((1 - self.bad) / self.bad), -700, 700)))


def fit(votes: DataFrame) -> VoteModel:
    """Learned from the counts of all vote patterns: at most 2 to the number of rules, however many rows."""
    found = votes.groupBy(*VOTES).count().collect()
    patterns = np.array([[r[v] for v in VOTES] for r in found], np.int64).reshape(len(found), len(VOTES))
    return VoteModel(patterns, np.array([r["count"] for r in found], float))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: its id, ``MEASURES``, the votes, ``p_good``, ``base_failed`` and ``kept``.

    ``kept`` needs a passed base (10 words or more, at most a fifth of them in repeated five-word
    windows) and a posterior of ``threshold`` for the good class. A null text is an empty one and
    fails the base. Rows are judged one by one, repeated ids too. An empty table gives no rows.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text)).alias("m")).select("doc_id", "m.*")
    votes = materialize(whole.withColumns(rules()), "quality-votes")
    model = fit(votes)
    logit = F.lit(math.log((1 - model.bad) / model.bad))
    for rule, worth in zip(VOTES, model.worth, strict=True):
        logit = logit + F.when(F.col(rule) != 0, float(worth[1])).otherwise(float(worth[0]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return votes.withColumn("p_good", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))


travel(__name__)
