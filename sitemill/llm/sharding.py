"""Sharding by extendible hashing: a directory of hash prefixes, in which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.llm.common import numbered
from sitemill.session import materialize

#: Hash bits from the id, then from the row's number: rows of one id can be parted too.
ID_BITS, ROW_BITS = 60, 40
DEPTH = ID_BITS + ROW_BITS
#: Bits that the first round looks at beyond those that an even split would need.
SPARE = 6


def _bits(hexes: Column, width: int) -> Column:
    return F.lpad(F.conv(F.substring(hexes, 1, width // 4), 16, 2), width, "0")


def keyed(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, bytes`` and ``bits`` (the hash as a text of 0 and 1), written."""
    row, name = F.col("row").cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return materialize(
        rows.select(
            "row",
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"),
            F.concat(_bits(F.md5(name), ID_BITS), _bits(F.md5(row), ROW_BITS)).alias("bits"),
        ),
        "shard-keys",
    )


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """``level, cell, shard, depth, shard_bytes, shard_docs``: the shard of every cell of the hash space.

    A bucket splits on its next bit while it is over the limit and has two documents. The splits of
    a round are found together: bytes are summed per cell (a prefix of as many bits as an even split
    needs, and some more), rolled up to all shorter prefixes, and the first prefix that fits is the
    shard. Only rows of cells that are still oversized go to the next round with more bits.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    found, depth = None, 0
    level = min(DEPTH, SPARE + max(0, math.ceil(math.log2(max(1.0, total / limit)))))
    rows = keys.select("bits", "bytes")
    while True:
        cells = materialize(
            rows.groupBy(F.substring("bits", 1, level).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-cells"
        )
        above = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(level)))).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        sums = above.groupBy("prefix", "depth").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == DEPTH)
        sums = materialize(sums.withColumn("fits", fits), "shard-sums")
        split = sums.where(~F.col("fits")).select(F.col("prefix").alias("parent"))
        parted = sums.where(F.col("fits") & (F.col("depth") > depth)).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)")).join(split, "parent", "left_semi")
        shards = parted.drop("parent").unionByName(sums.where(F.col("fits") & (F.col("depth") == 0)))
        known = above.select("cell", "prefix", "depth").join(shards, ["prefix", "depth"]).select(
            F.lit(level).alias("level"), "cell", F.col("prefix").alias("shard"), "depth", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs")
        )
        found = known if found is None else found.unionByName(known)
        oversized = sums.where(~F.col("fits") & (F.col("depth") == level)).select(F.col("prefix").alias("cell"))
        if oversized.isEmpty():
            return materialize(found, "shard-directory")
        rows = materialize(
            rows.withColumn("cell", F.substring("bits", 1, level)).join(oversized, "cell", "left_semi").select("bits", "bytes"), "shard-open"
        )
        depth, level = level, min(DEPTH, level + SPARE)


def assign_rows(rows: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    keys = keyed(rows, doc_id, text)
    cells = directory(keys, limit)
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # one, unless a bucket needs far more bits
    probed = keys.withColumn("level", F.explode(F.lit(levels or [0]).cast("array<int>"))).withColumn("cell", F.expr("substring(bits, 1, level)"))
    return probed.join(cells, ["level", "cell"]).select("row", "doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def assign(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, bytes, shard`` (its hash prefix), ``depth, shard_bytes, shard_docs``.

    A null text has 0 bytes, a null id counts as the id ''. Rows that repeat an id share its bits and,
    if their bucket is oversized, are parted by bits of their row number. A document larger than the
    limit ends in a shard of its own. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return assign_rows(rows, limit).drop("row")


def write_shards(docs: DataFrame, limit: int, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents to one folder ``shard=s<prefix>`` per shard, each by one task."""
    rows = numbered(docs, "shard-docs")
    shards = assign_rows(rows.select("row", F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text")), limit)
    named = shards.select("row", F.concat(F.lit("s"), F.col("shard")).alias("shard"))
    rows.join(named, "row").select("doc", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
