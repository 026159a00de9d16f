"""Archive record extraction: byte ranges named by pointers, decoded to HTTP responses."""

from __future__ import annotations

import gzip
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.session import resolved

RANGE_BYTES = 64 * 1024 * 1024
POINTER = ("warc_filename", "warc_record_offset", "warc_record_length")
RESPONSE = (
    "target_uri string, status int, headers map<string,string>, body binary, text string, "
    "charset_fallback boolean, error string"
)


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a slice, or the slice itself when it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(16 + zlib.MAX_WBITS)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def _head(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, header fields and the rest of a header block."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        head, found, rest = block.partition(gap)
        if found:
            break
    lines = head.decode("utf-8", "replace").splitlines() or [""]
    fields = [(k.strip(), v.strip()) for k, _, v in (ln.partition(":") for ln in lines[1:])]
    return lines[0], fields, rest if found else b""


def _get(fields: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in fields if k.lower() == name), "")


def _content(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """Undo chunked transfer and gzip/deflate content coding."""
    if "chunked" in _get(fields, "transfer-encoding").lower():
        whole, rest = b"", body
        while rest:
            size, found, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                whole += size + found + rest
                break
            if n == 0:
                break
            whole, rest = whole + rest[:n], rest[n + 2 :]
        body = whole
    coding = _get(fields, "content-encoding").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if coding == "deflate":
            return zlib.decompress(body)
    except (OSError, zlib.error, EOFError):
        pass
    return body


def _text(fields: list[tuple[str, str]], body: bytes) -> tuple[str, bool]:
    """Body text by the declared charset; an unknown one falls back to UTF-8 and is flagged."""
    _, found, name = _get(fields, "content-type").lower().partition("charset=")
    charset = name.split(";")[0].strip() if found else "utf-8"
    try:
        return body.decode(charset, "replace"), False
    except LookupError:
        return body.decode("utf-8", "replace"), True


def read_response(data: bytes) -> dict:
    """The first response record of a slice."""
    for member in _members(data):
        while member.strip():
            _, fields, rest = _head(member.lstrip())
            size = int(_get(fields, "content-length") or len(rest))
            block, member = rest[:size], rest[size:]
            if _get(fields, "warc-type") != "response":
                continue
            status_line, http, body = _head(block)
            parts = status_line.split()
            body = _content(http, body)
            text, fell_back = _text(http, body)
            return {
                "target_uri": _get(fields, "warc-target-uri"),
                "status": int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 0,
                "headers": dict(http),
                "body": body,
                "text": text,
                "charset_fallback": fell_back,
                "error": None,
            }
    raise ValueError("no response record in slice")


def _failed(message: str) -> dict:
    return dict.fromkeys(
        ("target_uri", "status", "headers", "body", "text", "charset_fallback")
    ) | {"error": message}


def archive_responses(pointers: DataFrame, root: str) -> DataFrame:
    """Pointer rows with the response they point at, or the ``error`` that kept it away.

    Files live below ``root``, which means what it means to Spark: without a scheme it lies in
    the default file system. Pointers are gathered by file and 64 MB range and sorted by offset, so a task
    reads forward, and a file with most of the pointers is spread over many tasks.
    """
    cols, uri = pointers.columns, resolved(pointers.sparkSession, root)
    located = (
        pointers.repartition("warc_filename", F.floor(F.col("warc_record_offset") / RANGE_BYTES))
        .sortWithinPartitions("warc_filename", "warc_record_offset")
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        name, handle = None, None
        for batch in batches:
            # Few rows at a time: bodies are large.
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                rows = []
                for file, offset, length in zip(*(part[c] for c in POINTER), strict=True):
                    try:
                        if pd.isna(length) or length <= 0:
                            raise ValueError("warc_record_length must be positive")
                        if pd.isna(offset) or offset < 0:
                            raise ValueError("warc_record_offset must be non-negative")
                        if file != name:
                            name, handle = None, store.open_input_file(f"{base}/{file.lstrip('/')}")
                            name = file
                        rows.append(read_response(handle.read_at(int(length), int(offset))))
                    except Exception as e:  # one bad record is a reject, not a failed job
                        rows.append(_failed(f"{type(e).__name__}: {e}"))
                found = pd.DataFrame(rows)
                yield pd.concat([part.reset_index(drop=True), found], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pointers.schema)
    return located.mapInPandas(extract, f"{schema}, {RESPONSE}").select(*cols, "target_uri", "status", "headers", "body", "text", "charset_fallback", "error")


def archive_records(
    pointers: DataFrame, root: str, limit: int | None = None, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records and rejects. ``limit`` takes the first pointers in ``order``, before extraction."""
    if limit is not None:
        pointers = (pointers.orderBy(order) if order else pointers).limit(limit)
    rows = archive_responses(pointers, root)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select(
        *pointers.columns, "error"
    )


# Tasks receive these helpers by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
