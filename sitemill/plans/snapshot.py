"""Table snapshots: write, manifest, restore, status roll-ups."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "component string, path string, row_count long, status string, detail string"


def write(tables: dict[str, DataFrame], path: str, parallel: int = 4) -> DataFrame:
    """Write every table below ``path`` and return the manifest, one row per table.

    Counts are read back from the written files, not taken from the writer. An empty table
    is recorded as ``empty``, a failing one as ``failed`` without stopping the others.
    """
    spark = next(iter(tables.values())).sparkSession

    def one(item: tuple[str, DataFrame]) -> tuple:
        name, df = item
        target = f"{path}/{name}"
        try:
            df.write.mode("overwrite").parquet(target)
            n = spark.read.parquet(target).count()
            return name, target, n, "ok" if n else "empty", None
        except Exception as e:
            return name, target, 0, "failed", f"{type(e).__name__}: {e}"

    # Threads only submit jobs; several tables are written at once.
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, tables.items()))
    manifest = spark.createDataFrame(rows, MANIFEST)
    manifest.write.mode("overwrite").json(f"{path}/_manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest")


def restore(spark: SparkSession, path: str, names: list[str], target: str, parallel: int = 4) -> DataFrame:
    """Copy the named tables of a snapshot below ``target``: ``component, row_count, status, detail``.

    A table the snapshot does not have is skipped, an empty one is reported empty. A table
    is ok only when the rows stored are those the manifest counted; fewer make it partial.
    """
    known = {r["component"]: r for r in read_manifest(spark, path).collect()}

    def one(name: str) -> tuple:
        entry = known.get(name)
        if entry is None or entry["status"] == "failed":
            return name, 0, "skipped", "not present in snapshot"
        if entry["row_count"] == 0:
            return name, 0, "empty", None
        try:
            spark.read.parquet(entry["path"]).write.mode("overwrite").parquet(f"{target}/{name}")
            n = spark.read.parquet(f"{target}/{name}").count()
        except Exception as e:
            return name, 0, "failed", f"{type(e).__name__}: {e}"
        return name, n, "ok" if n == entry["row_count"] else "partial", None

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, names))
    return spark.createDataFrame(rows, "component string, row_count long, status string, detail string")


def _has(*statuses: str) -> Column:
    return F.coalesce(F.bool_or(F.col("status").isin(*statuses)), F.lit(False))


def snapshot_status(manifest: DataFrame) -> DataFrame:
    """complete when all components are ok, partial when any is ok or empty, else failed."""
    return manifest.agg(
        F.when(F.bool_and(F.col("status") == "ok"), "complete")
        .when(_has("ok", "empty"), "partial")
        .otherwise("failed")
        .alias("status"),
        F.count("*").alias("components"),
        F.sum("row_count").alias("row_count"),
    )


def restore_status(restored: DataFrame) -> DataFrame:
    """complete when all are ok or skipped, partial when any is ok or partial, else failed."""
    return restored.agg(
        F.when(F.bool_and(F.col("status").isin("ok", "skipped")), "complete")
        .when(_has("ok", "partial"), "partial")
        .otherwise("failed")
        .alias("status"),
        F.count("*").alias("components"),
        F.sum("row_count").alias("row_count"),
    )
