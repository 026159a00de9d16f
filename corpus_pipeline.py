"""Corpus pipeline: documents to token ids, each stage one operator of ``sitemill.llm``.

``STAGES`` are functions of (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm import bpe, exact, langid, mixing, neardup
from sitemill.llm.common import prepare
from sitemill.llm.queries import MIX_REST, MIX_SEED, MIX_WEIGHTS, vocabulary
from sitemill.session import MADE, materialize, remove

#: A text goes when the next best language packs it to no more than this share above the best one.
MARGIN = 0.002
#: Similarity of near-duplicates: shared shingles of 100.
PERCENT = 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage that ran last.
_left: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage that first removes what the stage before it left: that one's result is written by then."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        before = len(MADE)
        result = function(prepare(spark), docs, sf_dir)
        _left[:] = MADE[before:]
        return result

    return run_stage


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts without a letter (null and empty ones too) and undecided ones go.

    The dictionaries are learned from the documents below ``sf_dir``, whatever table is judged. Copies and
    repeated rows fare alike; an empty table stays empty.
    """
    columns = docs.columns
    known = langid.learn(langid.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return langid.keep_known(docs, known, margin=MARGIN).select(*columns)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without blanks: the longest, then the smallest id.

    Null counts as empty, and empty texts are one group; of repeated rows one stays; an empty table stays empty.
    """
    return exact.deduplicate(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest id.

    Texts without a word are linked with nothing and stay; repeated rows are near-duplicates of each other; an
    empty table stays empty.
    """
    return neardup.deduplicate(docs, PERCENT)


@stage
def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, globally shuffled.

    A null source is one of its own; rows with one id get one count; an empty table stays empty.
    """
    return mixing.mix(docs, MIX_WEIGHTS, MIX_REST, seed=MIX_SEED).select("doc.*")


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked by decoding them: ``doc_id, source, n_tokens, ids, round_trip``."""
    both = docs.select("doc_id", "source", "text", bpe.round_trip(spark, vocabulary())(F.col("text")).alias("both"))
    return both.select(
        "doc_id",
        "source",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.col("both.ids").alias("ids"),
        (F.col("both.decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", target_mix),
    ("BPE", token_ids),
]

#: Compression and MinHash cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
