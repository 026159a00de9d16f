"""Keyed merges of a batch into a table: deduplicate, upsert, insert-ignore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.operators.ranking import number_rows, one_per_key
from sitemill.session import materialize


def dedupe_last(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, as sequential upserts would leave it."""
    return one_per_key(batch, keys, [F.col(order).desc()])


def dedupe_first(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return one_per_key(batch, keys, [F.col(order).asc()])


def _require_keys(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job on a null key, as a NOT NULL column would."""
    checked = {
        k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null key: {k}"))).otherwise(F.col(k))
        for k in keys
    }
    return batch.withColumns(checked)


def _aligned(df: DataFrame, columns: Sequence[str], schema) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(schema[c].dataType).alias(c)
            for c in columns
        ]
    )


def upsert(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: str | None = None,
    update: Sequence[str] | None = None,
    new_values: dict[str, Column] | None = None,
    id_column: str | None = None,
    id_start: int | None = None,
) -> DataFrame:
    """The table after the batch: known keys take ``update`` columns, unknown keys are added.

    Other columns of known rows (id, creation time) stay; ``new_values`` fills columns of
    added rows, and ``id_column`` numbers them after the current maximum (or ``id_start``, where
    ``current`` is a part of the table). ``update=None`` replaces every non-key column. Without ``order`` the batch must have unique keys.

    The batch is reduced and written first, so the size that Spark plans the joins with is that of a
    file and not a guess: a small batch leaves the table where it is, a large one moves both. The
    table is read once in full and once for its keys.
    """
    keys = list(keys)
    batch = _require_keys(batch, keys)
    if order is not None:
        batch = dedupe_last(batch, keys, order)
    batch = materialize(batch, "merge-batch")
    update = [c for c in current.columns if c not in keys] if update is None else list(update)
    incoming = batch.select(
        *keys, F.struct(*[F.col(c) for c in update]).alias("_new")
    )

    rows = current.join(incoming, keys, "left")
    known = F.col("_new").isNotNull()
    kept = rows.select(*[F.when(known, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in current.columns])
    seen = current.select(*keys).join(batch.select(*keys), keys, "left_semi")
    added = batch.join(seen, keys, "left_anti").select(*keys, *update)
    added = added.withColumns(new_values or {})
    added = _aligned(added, current.columns, current.schema)
    if id_column is not None:
        # A one-row aggregate, read once as the start of the numbering.
        start = current.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0] if id_start is None else id_start
        added = number_rows(added, keys, id_column, F.lit(start)).select(*current.columns)
        added = _aligned(added, current.columns, current.schema)
    return kept.unionByName(added)


def insert_ignore(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table plus the first batch row of each key it does not have yet."""
    keys = list(keys)
    fresh = materialize(dedupe_first(batch, keys, order), "merge-batch")
    known = current.select(*keys).join(fresh.select(*keys), keys, "left_semi")
    added = fresh.join(known, keys, "left_anti")
    return current.unionByName(_aligned(added, current.columns, current.schema))


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Write a new version folder, then a pointer row naming it.

    Readers follow the newest pointer, so a failed write is never seen and the version
    being read is never overwritten.
    """
    path = f"{root}/data/v{version:08d}"
    table.write.mode("overwrite").parquet(path)
    spark = table.sparkSession
    spark.createDataFrame([(version, path)], "version long, path string").write.mode(
        "overwrite"
    ).json(f"{root}/pointer/v={version:08d}")
    return path


def read_version(spark, root: str) -> DataFrame:
    """The table version named by the newest pointer."""
    pointer = spark.read.schema("version long, path string").json(f"{root}/pointer/*")
    newest = pointer.agg(F.max(F.struct("version", "path"))["path"].alias("path")).first()
    return spark.read.parquet(newest["path"])


def load_gate(scraped: int, stored: int) -> None:
    """Fail when nothing was scraped or not every distinct key was stored."""
    if scraped == 0:
        raise RuntimeError("scrape returned 0 items")
    if stored != scraped:
        raise RuntimeError(f"only {stored}/{scraped} scraped item(s) were stored")
