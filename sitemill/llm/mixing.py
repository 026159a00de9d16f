"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.session import materialize

#: A rate above this is drawn as a sum of equal smaller ones, so exp(-rate) stays in range.
PIECE = 32.0
#: More counts than a piece can reach with probability 2**-53.
COUNTS = 150
#: Sources up to this number are broadcast (a few KB each at most); beyond it the join is salted.
BROADCAST_SOURCES = 5_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts (52 bits)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, weights: Mapping[str | None, float], rest: float, size: int | None = None, source: str = "source") -> DataFrame:
    """Per source: ``source, n, rate`` (target rows per row).

    ``weights`` are shares of the result; ``rest`` is shared by the sources not named there, in
    proportion to their rows. Shares of named sources without rows go to no one. ``size`` is the
    target number of rows (default: as many as there are). Null is a source of its own.
    """
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(None).cast("double")
    for name, weight in weights.items():
        share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    counts = materialize(counts.withColumn("share", share), "mix-counts")
    total, others = counts.agg(F.sum("n"), F.sum(F.when(F.col("share").isNull(), F.col("n")))).first()
    whole, aim = float(sum(weights.values()) + rest), float(size if size is not None else total or 0)
    return counts.select(
        "source",
        "n",
        F.when(F.col("share").isNotNull(), F.lit(aim) * F.col("share") / F.lit(whole) / F.col("n"))
        .otherwise(F.lit(aim * rest / whole) / F.lit(float(others or 1)))
        .alias("rate"),
    )


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds ``pieces`` and ``cdf``, the cumulative Poisson distribution of one piece."""
    one = F.col("rate") / F.col("pieces")
    start = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(COUNTS)),
        start,
        lambda acc, k: F.struct(
            (acc["p"] * one / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * one / k)).alias("cdf")
        ),
        lambda acc: acc["cdf"],
    )
    return rates.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE).cast("int"))).withColumn("cdf", grown)


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float],
    rest: float,
    size: int | None = None,
    seed: int = 0,
    source: str = "source",
    doc_id: str = "doc_id",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Every document as often as a Poisson draw with its source's rate says, globally shuffled.

    Returns ``doc`` (the document as a struct), ``copy`` (1 to its count), ``rate`` and
    ``shuffle_key``; rows are dealt out and ordered by that key. The draw inverts the distribution
    at a number hashed from seed, id and piece, so a rerun gives the same rows: rows with one id
    get one count, a null id counts as the id ''. An empty text is a document as any other. An
    empty table gives no rows.
    """
    facts = materialize(with_distribution(rates(docs, weights, rest, size, source)), "mix-rates")
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.col(f"doc.`{source}`").cast("string").alias("source"), F.coalesce(F.col(f"doc.`{doc_id}`").cast("string"), F.lit("")).alias("id"))
    facts = facts.select(F.col("source").alias("of"), "rate", "pieces", "cdf")
    if facts.count() <= broadcast_sources:
        known = rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("of")))
    else:
        salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(
            salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))
        )
    numbers = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda piece: uniform(F.lit(f"draw{seed}"), piece.cast("string"), F.col("id")))
    draw = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    return (
        known.withColumn("count", draw)
        .where("count > 0")
        .select("doc", "id", "rate", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
        .withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col("copy").cast("string"), F.col("id"))), 1, 15), 16, 10).cast("long"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key", "id")
        .select("doc", "copy", "rate", "shuffle_key")
    )
