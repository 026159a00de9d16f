"""Commits: small files that are created once or not at all, and batches of several tables that they make visible together."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.session import remove

#: Ends a complete commit; a file without it is still being written and does not count.
END = "\n#end\n"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file unless it is there; of several writers one gets true."""
    place, system = _place(spark, path)
    system.mkdirs(place.getParent())
    if system.getScheme() == "file":  # a link to a complete file either comes into being or fails
        target = system.resolvePath(place.getParent()).toUri().getPath() + "/" + place.getName()
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text + END)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = system.create(place, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray((text + END).encode()))
    out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none when it is not there."""
    place, system = _place(spark, folder)
    if not system.exists(place):
        return []
    found = (s.getPath().getName() for s in system.listStatus(place))
    return sorted(n for n in found if not n.startswith("."))


def content(spark: SparkSession, path: str) -> str | None:
    """The text of a complete commit, else null."""
    text = spark.read.text(path, wholetext=True).first()
    text = text[0] if text else ""
    return text.removesuffix(END) if text.endswith(END) else None


def write_batch(spark: SparkSession, root: str, batch: str, tables: Mapping[str, DataFrame], by: str | None = None) -> bool:
    """Adds rows to several tables below ``root`` at once; false, and nothing done, when the batch is there already.

    Each table's rows go to a folder of their own (``by`` day or the like below it). Readers follow
    the commit that names all folders, so a failure in between shows nothing, and a batch that is
    tried again, by this or another writer, counts once.
    """
    commit = f"{root}/commits/{batch}"
    if batch in names(spark, f"{root}/commits") and content(spark, commit) is not None:
        return False
    made = {name: f"{root}/{name}/batch={batch}-{uuid.uuid4().hex[:12]}" for name in tables}
    try:
        for name, rows in tables.items():
            writer = rows.write.partitionBy(by) if by else rows.write
            writer.parquet(made[name])
        done = create_once(spark, commit, json.dumps({n: p.removeprefix(f"{root}/") for n, p in made.items()}))
    except BaseException:
        remove(spark, list(made.values()))
        raise
    if not done:
        remove(spark, list(made.values()))
    return done


def read_batches(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all committed batches of a table. The commits, a line each, are read by Spark; their folders' names come to the driver, as a file listing does. A table without a batch has no rows, and needs a ``schema``."""
    if not names(spark, f"{root}/commits"):
        return spark.createDataFrame([], schema or T.StructType())
    lines = spark.read.text(f"{root}/commits", wholetext=True).where(F.col("value").endswith(END))
    folders = lines.select(F.get_json_object(F.replace("value", F.lit(END), F.lit("")), f"$.{table}").alias("p")).where("p IS NOT NULL")
    paths = [f"{root}/{r['p']}" for r in folders.collect()]
    if not paths:
        return spark.createDataFrame([], schema or T.StructType())
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", f"{root}/{table}").parquet(*paths).drop("batch")
