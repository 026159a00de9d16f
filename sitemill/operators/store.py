"""Keyed tables in buckets: a merge rewrites the buckets that its batch touches, and nothing else.

A version is a manifest: per bucket the folder that holds its rows. A writer reads the newest
manifest, writes the touched buckets to a new folder and commits the next version by creating its
manifest if absent. Of two writers one wins; the other starts over from the version that won.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.operators import merge
from sitemill.session import materialize, remove
from sitemill.sources.commits import content, create_once, names

#: Buckets of a new table. As many as make each a few hundred MB at the size it is to grow to.
BUCKETS = 64
TRIES = 8


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    buckets: int
    schema: str
    id_column: str | None
    #: bucket -> folder, rows, highest id
    parts: dict[str, list]

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    @property
    def top(self) -> int:
        return max((p[2] or 0 for p in self.parts.values()), default=0)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, root: str, version: Version) -> bool:
    return create_once(spark, f"{root}/versions/{version.number:08d}", json.dumps(asdict(version)))


def newest(spark: SparkSession, root: str) -> Version:
    """The newest complete version."""
    for name in reversed(names(spark, f"{root}/versions")):
        text = content(spark, f"{root}/versions/{name}")
        if text is not None:
            return Version(**json.loads(text))
    raise FileNotFoundError(f"no table at {root}")


def exists(spark: SparkSession, root: str) -> bool:
    return bool(names(spark, f"{root}/versions"))


def _write(rows: DataFrame, root: str, version: Version) -> tuple[dict[str, list], str]:
    """Rows by bucket in a new folder; what the manifest says of them."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    spark = rows.sparkSession
    rows.withColumn("_bucket", _bucket(version.keys, version.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    kinds = T.StructType([*version.struct.fields, T.StructField("_bucket", T.IntegerType())])
    top = F.max(version.id_column).cast("long") if version.id_column else F.lit(None).cast("long")
    found = spark.read.schema(kinds).parquet(folder).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
    return {str(r["_bucket"]): [f"{folder}/_bucket={r['_bucket']}", r["n"], r["top"]] for r in found.collect()}, folder


def create(rows: DataFrame, root: str, keys: Sequence[str], buckets: int = BUCKETS, id_column: str | None = None) -> bool:
    """A new table with ``rows`` (unique by ``keys``); false when there is one already."""
    spark = rows.sparkSession
    version = Version(1, list(keys), buckets, rows.schema.json(), id_column, {})
    parts, folder = _write(rows, root, version)
    done = _commit(spark, root, replace(version, parts=parts))
    if not done:
        remove(spark, [folder])
    return done


def _rows(spark: SparkSession, version: Version, buckets: Sequence[str] | None = None) -> DataFrame:
    paths = [p[0] for b, p in version.parts.items() if buckets is None or b in buckets]
    return spark.read.schema(version.struct).parquet(*paths) if paths else spark.createDataFrame([], version.struct)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table, or an earlier version of it."""
    if number is None:
        return _rows(spark, newest(spark, root))
    return _rows(spark, Version(**json.loads(content(spark, f"{root}/versions/{number:08d}"))))


def rewrite(spark: SparkSession, root: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame, Version], DataFrame], tries: int = TRIES) -> Version:
    """The version after ``change(rows of the touched buckets, batch, version before)``; an empty batch makes none.

    The batch is written first, so a repeated try sees the same rows.
    """
    version = newest(spark, root)
    kinds = version.struct
    batch = batch.withColumns({k: F.col(k).cast(kinds[k].dataType) for k in version.keys})
    batch = materialize(batch.withColumn("_bucket", _bucket(version.keys, version.buckets)), "merge-batch")
    touched = {str(r[0]) for r in batch.select("_bucket").distinct().collect()}  # no more than there are buckets
    batch = batch.drop("_bucket")
    for _ in range(tries if touched else 0):
        after = change(_rows(spark, version, touched), batch, version).select(*kinds.names)
        parts, folder = _write(after, root, version)
        kept = {b: p for b, p in version.parts.items() if b not in touched}
        following = replace(version, number=version.number + 1, parts=kept | parts)
        if _commit(spark, root, following):
            return following
        remove(spark, [folder])
        version = newest(spark, root)
    if touched:
        raise RuntimeError(f"other writers were first {tries} times")
    return version


def upsert(
    spark: SparkSession, root: str, batch: DataFrame, order: str | None = None, update: Sequence[str] | None = None, new_values: dict[str, Column] | None = None, tries: int = TRIES
) -> Version:
    """``merge.upsert`` of a batch into the table; see there."""

    def change(current: DataFrame, batch: DataFrame, version: Version) -> DataFrame:
        return merge.upsert(current, batch, version.keys, order, update, new_values, version.id_column, version.top)

    return rewrite(spark, root, batch, change, tries)


def insert_ignore(spark: SparkSession, root: str, batch: DataFrame, order: str, tries: int = TRIES) -> Version:
    """``merge.insert_ignore`` of a batch into the table; see there."""
    return rewrite(spark, root, batch, lambda current, batch, version: merge.insert_ignore(current, batch, version.keys, order), tries)
