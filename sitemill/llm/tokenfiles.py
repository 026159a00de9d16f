"""Token-id files: Parquet with a list column of ids, small row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.bpe import id_lists, rows_of
from sitemill.llm.chunks import ByteLevel, library
from sitemill.llm.common import travel

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"

#: Ids repeat: dictionary. Ascending and near numbers: binary packed deltas (format version 2).
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "compression": "zstd",
}

#: The encoder of byte-level vocabularies, from the text of the vocabulary file.
library_encoder = ByteLevel


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Writes the documents' ids in ascending ``doc_id``, each with ``end_id`` appended.

    Files are range partitions by id and row number, so that rows with one id can lie in several.
    Every row holds its file's number (``part``) and the ids before it in that file
    (``part_start``). Ids are read as long integers (text that is no number is an error). Null ids
    come first, a null text is empty and has only the end id. An empty table writes files without rows.
    """
    encoder = library(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, part, before = encoder(), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in batches:
            lists = id_lists([ids + end for ids in (to_ids(t or "") for t in batch.column(1).to_pylist())])
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts), pa.array(sizes), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "row"]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ``start`` counts the ids of all documents before.

    Select no ``ids`` to read metadata only; a filter on ``doc_id`` skips files, row groups and
    pages by their statistics. The files' totals (a row each) are all that is summed up globally.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(sums), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def checksum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows_of(lists)], pa.int64())

    checksum.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(checksum, T.LongType())(ids)


travel(__name__)
