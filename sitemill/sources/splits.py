"""Large CSV files with line breaks in quotes, and large JSON arrays, read by many tasks.

Spark's text reader cuts a file at a separator (line feeds, or commas) in as many tasks as it has
ranges. Whether a separator ends a record depends on what stands before it: open quotes, open
brackets. A first pass tells, per range, what it does to that state from either start (outside or
inside quotes); the ranges' effects, a row each, are put in sequence; in a second pass every range
knows its start and gives whole records. Only records that lie across ranges are shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside quotes or not, and how many brackets are open.
State = tuple[bool, int]
NEVER = 1 << 40
#: Records of one Arrow batch.
BATCH_RECORDS = 4096


def csv_step(line: str, inside: bool) -> State:
    """The state after a line. A quote opens a value at its start only; after the closing one a value goes on to the next comma."""
    at, size = 0, len(line)
    while True:
        if inside:
            end = line.find('"', at)
            while end >= 0 and line.startswith('""', end):
                end = line.find('"', end + 2)
            if end < 0:
                return True, 0
            at, inside = end + 1, False
        elif at < size and line[at] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False, 0


_CLOSES = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL).match
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)', re.DOTALL)
_WHOLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def json_step(part: str, inside: bool) -> State:
    """The state after what stands between two commas, and the brackets it opens more than it closes."""
    if inside:
        end = _CLOSES(part)
        if not end:
            return True, 0
        part = part[end.end() :]
    if '"' in part:
        part = _WHOLE.sub("", part)
        if '"' in part:
            part, inside = _STRING.sub("", part), True
            return inside, sum(map(part.count, "[{")) - sum(map(part.count, "]}"))
    return False, sum(map(part.count, "[{")) - sum(map(part.count, "]}"))


@dataclass(frozen=True)
class Format:
    """``separator`` of the text reader, ``step`` over what stands between two, brackets open between records, where a file is ``single``."""

    separator: str
    step: Callable[[str, bool], State]
    level: int
    single: str = ""


CSV_FORMAT = Format("\n", csv_step, 0)
JSON_FORMAT = Format(",", json_step, 1, "{")


def _parts(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    text = spark.read.option("lineSep", kind.separator).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The parts of each range of a task, in order."""
    for batch in batches:
        values, files, blocks = (batch.column(c).to_pylist() for c in range(3))
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or blocks[i] != blocks[first] or files[i] != files[first]:
                yield (files[first], blocks[first]), values[first:i]
                first = i


def _effects(parts: DataFrame, kind: Format) -> DataFrame:
    """Per range and start (outside, inside): the state at its end, and the fewest brackets open at any of its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, lows, opens = None, None, None, None

        def row() -> pa.RecordBatch:
            names = ["file", "block", "opens", "end_out", "delta_out", "low_out", "end_in", "delta_in", "low_in"]
            return pa.RecordBatch.from_pydict(dict(zip(names, [[v] for v in (*at, opens, *ends[0], lows[0], *ends[1], lows[1])], strict=True)))

        for where, values in _by_range(batches):
            if where != at:
                if at:
                    yield row()
                at, ends, lows, opens = where, [(False, 0), (True, 0)], [NEVER, NEVER], ""
            for value in values:
                opens = opens or value.lstrip("\ufeff \t\r\n")[:1]
                together = ends[0] == ends[1]  # from here on both starts go the same way
                for k in (0,) if together else (0, 1):
                    inside, more = kind.step(value, ends[k][0])
                    ends[k] = (inside, ends[k][1] + more)
                if together:
                    ends[1] = ends[0]
                for k in (0, 1):
                    if not ends[k][0]:
                        lows[k] = min(lows[k], ends[k][1])
        if at:
            yield row()

    schema = "file string, block long, opens string, end_out boolean, delta_out long, low_out long, end_in boolean, delta_in long, low_in long"
    return parts.mapInArrow(run, schema)


def _starts(effects: DataFrame, kind: Format) -> dict[tuple[str, int], tuple[bool, int, int, int]]:
    """Per range: inside quotes, open brackets, the range in which the open record began, brackets open between records.

    One row per range of the text reader comes to the driver, as its file listing did.
    """
    found, state, since, file, level = {}, (False, 0), -1, None, kind.level
    for r in sorted(effects.collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, state, since = r["file"], (False, 0), -1
            level = NEVER if kind.single and r["opens"] == kind.single else kind.level
        inside, depth = state
        found[file, r["block"]] = (inside, depth, since, level)
        name = "in" if inside else "out"
        end = (r[f"end_{name}"], depth + r[f"delta_{name}"])
        if not end[0] and end[1] == level:
            since = -1
        elif since < 0 or depth + r[f"low_{name}"] <= level:
            since = r["block"]
        state = end
    return found


def records(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """``record, first, last``: the text of every record, without the separator at its end; the first of its file; all brackets are closed behind it."""
    parts = _parts(spark, path, kind)
    known = spark.sparkContext.broadcast(_starts(_effects(parts, kind), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        ready: list[tuple] = []

        def batch() -> pa.RecordBatch:
            names = ["file", "since", "block", "record", "first", "last", "whole"]
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*ready, strict=True)), strict=True)))

        def open_record() -> tuple:
            return at[0], since, at[1], kind.separator.join(held), first, not inside and depth == level - 1, False

        for where, values in _by_range(batches):
            if where != at:
                if at and held:
                    ready.append(open_record())
                at, held = where, []
                inside, depth, since, level = known.value[where]
                began = since < 0  # the open record began in this range
                first = began and where[1] == 0
                since = where[1] if began else since
            for value in values:
                held.append(value)
                inside, more = kind.step(value, inside)
                depth += more
                if not inside and depth == level:
                    ready.append((where[0], since, where[1], kind.separator.join(held), first, False, began))
                    held, began, first, since = [], True, False, where[1]
                    if len(ready) >= BATCH_RECORDS:
                        yield batch()
                        ready = []
        if at and held:
            ready.append(open_record())
        if ready:
            yield batch()

    found = parts.mapInArrow(run, "file string, since long, block long, record string, first boolean, last boolean, whole boolean")
    pieces = found.where("not whole").groupBy("file", "since").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"), F.max("first").alias("first"), F.max("last").alias("last"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["record"]), kind.separator).alias("record"), "first", "last")
    return found.where("whole").select("record", "first", "last").unionAll(joined)


def read_csv(spark: SparkSession, path: str, options: dict, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header per file; a value may hold line breaks. Without a schema columns are text, named by the first header.

    Records end with a line feed, or a carriage return and one. Empty lines are skipped.
    """
    if schema is None:
        schema = spark.read.options(**options, multiLine=True).csv(path).schema
    found = records(spark, path, CSV_FORMAT)
    if options.get("header"):
        found = found.where("not first")
    rows = found.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
    ways = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"} | {"multiLine": "true"}
    return rows.select(F.from_csv("record", _ddl(schema), ways).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The elements of files that hold one array each; a file that holds one object is one row."""
    found = records(spark, path, JSON_FORMAT)
    opened = F.when(F.col("first"), F.regexp_replace("record", r"^[\ufeff\s]*\[", "")).otherwise(F.col("record"))
    closed = F.when(F.col("last"), F.regexp_replace(opened, r"\]\s*$", "")).otherwise(opened)
    rows = found.select(F.btrim(closed, F.lit(" \t\r\n")).alias("record")).where("record <> ''")
    if schema is None:
        schema = spark.read.json(rows.rdd.map(lambda r: r[0])).schema
    return rows.select(F.from_json("record", schema).alias("r")).select("r.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
