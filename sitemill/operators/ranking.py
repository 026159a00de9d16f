"""Latest-row, first-row and numbering operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.session import materialize


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``.

    The rank filter lets Spark keep one row per key in every map task before the
    shuffle, so a hot key costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The row of the greatest ``(ts, tie)`` per key for few keys over many rows.

    A hash aggregate finds the newest time per key without sorting the table; the
    second scan keeps only rows at that time, and ties are settled among those. The newest
    times are written first: with their size known Spark broadcasts them when they are
    small, where a guess from the table's size would move the whole table.
    """
    newest = df.groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("_t"))
    newest = materialize(newest, "newest")
    at_newest = df.join(
        newest, F.col(key).eqNullSafe(F.col("_k")) & F.col(ts).eqNullSafe(F.col("_t")), "left_semi"
    )
    return one_per_key(at_newest, [key], [F.col(ts).desc(), F.col(tie).desc()])


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: Column) -> DataFrame:
    """Consecutive numbers in ``order`` without sorting everything in one task.

    Rows are range-partitioned, numbered inside each partition and shifted by the
    sizes of the partitions before it. The ranged rows are written first, so both
    passes see the same partitions.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "numbered")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition: the running sum is over the partition count, not the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(shifts, "_part")
        .withColumn(name, start + F.col("_shift") + F.col("_pos"))
        .drop("_part", "_pos", "_shift")
    )
