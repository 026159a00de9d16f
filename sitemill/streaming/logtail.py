"""Log files that grow, as a streaming source: offsets are bytes per file.

``spark.readStream.format("logtail")`` gives the lines appended since the last batch. A file that is
seen for the first time, or that is shorter than where its last batch ended (rotated, truncated),
gives its last lines only. Files are listed and read through ``pyarrow.fs``, so a path may be
local, ``hdfs://``, ``s3://`` or ``gs://``; a log of any length is read range by range, a task each, and
short ones share a task.
"""

from __future__ import annotations

import fnmatch
import json
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from sitemill.constants import TAIL_LINES
from sitemill.functions.text import is_log_error, log_bundle, short, strip

SCHEMA = "path string, at long, value string"
#: Bytes of one range, of one read, and what opening a file counts for beside the bytes of a task.
RANGE_BYTES, READ_BYTES, OPEN_BYTES = 32 << 20, 1 << 20, 1 << 19
#: Files whose ends are looked at together.
LOOKS = 16
#: Lines of one Arrow batch.
BATCH_LINES = 8192


class Range:
    """Bytes ``start`` to ``end`` of a file. A line belongs to the range that holds its first byte; ``first`` starts at a line."""

    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


class Last:
    """The last ``lines`` lines before ``end``."""

    def __init__(self, path: str, end: int, lines: int):
        self.path, self.end, self.lines = path, end, lines


class Share(InputPartition):
    """Pieces of files that a task reads one after the other."""

    def __init__(self, pieces: list[Range | Last]):
        super().__init__(0)
        self.pieces = pieces


class Files:
    """The log files below a path."""

    def __init__(self, options):
        self.root = options["path"]
        self.pattern = options.get("pattern", "*.log")
        self.lines = int(options.get("lines", TAIL_LINES))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.ends: dict[str, tuple[int, int]] = {}

    def system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root or self.root.startswith("file:"):
            uri = self.root if "://" in self.root else self.root.replace("file:", "file://", 1)
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), self.root

    def last_line_end(self, system: fs.FileSystem, path: str, size: int) -> int:
        """Where the last complete line ends; a line that is still being written waits for its end."""
        with system.open_input_file(path) as f:
            at = size
            while at > 0:
                start = max(0, at - READ_BYTES)
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                at = start
        return 0

    def latest(self) -> dict[str, int]:
        system, root = self.system()
        found, changed = {}, {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                known = self.ends.get(info.path)
                if known and known[0] == info.size:
                    found[info.path] = known[1]
                else:
                    changed[info.path] = info.size
        if changed:
            with ThreadPoolExecutor(LOOKS) as pool:
                for (path, size), end in zip(changed.items(), pool.map(lambda c: self.last_line_end(system, *c), changed.items()), strict=True):
                    self.ends[path], found[path] = (size, end), end
        return {path: end for path, end in sorted(found.items()) if end}

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        """What each task reads: pieces of at most ``rangeBytes``, as many as fit when each file counts for some bytes more."""
        shares: list[Share] = []
        room = 0
        for path, size in end.items():
            before = start.get(path)
            if before is None or before > size:
                pieces = [(Last(path, size, self.lines), min(size, READ_BYTES))]
            else:
                pieces = [(Range(path, a, b, a == before), b - a) for a in range(before, size, self.range_bytes) for b in (min(size, a + self.range_bytes),)]
            for piece, length in pieces:
                if not shares or length + OPEN_BYTES > room:
                    shares.append(Share([]))
                    room = self.range_bytes
                shares[-1].pieces.append(piece)
                room -= length + OPEN_BYTES
        return shares

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, _ = self.system()
        ready: list[tuple[str, int, bytes]] = []
        for piece in share.pieces:
            with system.open_input_file(piece.path) as f:
                found = last_lines(f, piece.end, piece.lines) if isinstance(piece, Last) else lines_of(f, piece.start, piece.end, piece.first)
                for at, line in found:
                    ready.append((piece.path, at, line))
                    if len(ready) == BATCH_LINES:
                        yield batch_of(ready)
                        ready = []
        if ready:
            yield batch_of(ready)


def lines_of(f: pa.NativeFile, start: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """The lines that start in ``[start, end)`` and where; the last may reach beyond."""
    at = start if first else start - 1
    f.seek(at)
    rest, skip = b"", not first
    while True:
        data = f.read(READ_BYTES)
        if not data:
            break
        *lines, rest = (rest + data).split(b"\n")
        for line in lines:
            if at >= end:
                return
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1
        if at >= end:
            return


def last_lines(f: pa.NativeFile, end: int, lines: int) -> Iterator[tuple[int, bytes]]:
    """The last lines before ``end`` (which follows a line's end), read from the back."""
    at, tail = end, b""
    while at > 0 and tail.count(b"\n") <= lines:
        start = max(0, at - READ_BYTES)
        f.seek(start)
        tail = f.read(at - start) + tail
        at = start
    kept = tail[:-1].split(b"\n")[-lines:] if lines > 0 and tail else []
    at = end - sum(len(line) + 1 for line in kept)
    for line in kept:
        yield at, line
        at += len(line) + 1


def batch_of(lines: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    paths, at, values = zip(*lines, strict=True)
    texts = [v.removesuffix(b"\r").decode("utf-8", errors="ignore") for v in values]
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(texts, pa.string())], ["path", "at", "value"])


class TailStream(DataSourceStreamReader):
    def __init__(self, options):
        self.files = Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.latest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.files.between(start, end)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class TailBatch(DataSourceReader):
    """The same lines as a batch, counted from the offsets in the option ``since``."""

    def __init__(self, options):
        self.files, self.since = Files(options), json.loads(options.get("since", "{}"))

    def partitions(self) -> list[InputPartition]:
        return self.files.between(self.since, self.files.latest())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition) if partition is not None else iter(())


class LogTail(DataSource):
    """Options: ``path`` (a folder), ``pattern`` of file names, ``lines`` of a new file, ``rangeBytes`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailBatch:
        return TailBatch(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """New lines of the logs below ``path`` as a stream: ``path, at`` (byte) and ``value``."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("logtail").options(**options).load(path)


def committed(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """The offsets up to which a stream with this checkpoint has finished; none when it never ran."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return {}
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    batches = [int(n) for n in names if n.isdigit()]
    if not batches:
        return {}
    # A version line, a line of metadata, then the offsets of each source.
    text = spark.read.text(f"{checkpoint}/offsets/{max(batches)}", wholetext=True).first()[0]
    return json.loads(text.split("\n")[2])


def peek(spark: SparkSession, path: str, checkpoint: str, **options) -> DataFrame:
    """What the stream's next batch would read; moves nothing."""
    spark.dataSource.register(LogTail)
    since = json.dumps(committed(spark, checkpoint))
    return spark.read.format("logtail").options(since=since, **options).load(path)


def scan_errors(lines: DataFrame) -> DataFrame:
    """Each distinct ``bundle_name, message`` of the error lines."""
    errors = lines.filter(is_log_error(F.col("value")))
    return errors.select(log_bundle(F.col("value")).alias("bundle_name"), short(strip(F.col("value"))).alias("message")).distinct()


def write_scans(lines: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every batch's errors in a folder of its own, so that a repeated batch replaces itself.

    With ``once`` a run is one batch; a run after a failure repeats the batch that failed, with the same bytes.
    """

    def store(batch: DataFrame, number: int) -> None:
        scan_errors(batch).write.mode("overwrite").parquet(f"{path}/scan={number}")

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 seconds")
    return writer.start()


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bundle_name string, message string, scan long").parquet(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
