"""Parse routed pages to records, and derive run outcomes and record validity."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.functions.text import blank_to_null

Parser = Callable[[str, str], list[dict]]

# Fixed value: the columns every record has; other keys go to ``attrs``.
FIELDS = ("company_name", "website", "summary", "source_directory", "source_url")
VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
RECORD = ", ".join(f"{f} string" for f in FIELDS)


class _Node:
    """Element of a page tree. ``parts`` holds strings and child elements in order."""

    __slots__ = ("tag", "classes", "parts", "parent", "at")

    def __init__(self, tag: str, classes: tuple[str, ...], parent: _Node | None):
        self.tag, self.classes, self.parts, self.parent = tag, classes, [], parent
        self.at = len(parent.parts) if parent is not None else 0


class _Tree(HTMLParser):
    """Lenient tree: an end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", (), None)
        self.nodes: list[_Node] = []

    def handle_starttag(self, tag, attrs):
        names = next((v for k, v in attrs if k == "class" and v), "")
        node = _Node(tag, tuple(names.split()), self.open)
        self.open.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        parts = self.open.parts
        if parts and isinstance(parts[-1], str):
            parts[-1] += data
        else:
            parts.append(data)


def _text(node: _Node) -> str:
    """Stripped strings below a node joined by spaces; scripts and styles do not count."""
    found, stack = [], [iter(node.parts)]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                if part := part.strip():
                    found.append(part)
            elif part.tag not in ("script", "style", "template"):
                stack.append(iter(part.parts))
                break
        else:
            stack.pop()
    return " ".join(found)


def cards_parser(source_directory: str) -> Parser:
    """Records from headings and card/item elements; the summary is the next sibling paragraph."""

    def parse(html: str, source_url: str) -> list[dict]:
        tree = _Tree()
        tree.feed(html or "")
        tree.close()
        records = []
        for node in tree.nodes:
            if node.tag not in ("h1", "h2", "h3") and not {"card", "item"} & set(node.classes):
                continue
            title = _text(node)
            if len(title) < 2:
                continue
            later = islice(node.parent.parts, node.at + 1, None)
            paragraph = next((s for s in later if isinstance(s, _Node) and s.tag == "p"), None)
            records.append(
                {
                    "company_name": title,
                    "website": None,
                    "summary": title if paragraph is None else _text(paragraph),
                    "source_directory": source_directory,
                    "source_url": source_url,
                }
            )
        return records

    return parse


def extract_records(
    routed: DataFrame,
    parsers: dict[str, Parser],
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records and errors of routed pages.

    Each page with an ``extractor_id`` goes through that parser; an exception becomes an
    error row of the page. Row-local, so pages stay where they were read, unless ``tasks`` deals
    them out anew (for inputs that are few files).
    """
    id_type = routed.schema[page_id].dataType.simpleString()
    pages = routed.filter(F.col("extractor_id").isNotNull()).select(
        F.col(page_id).alias("page_id"), "extractor_id", F.col(url).alias("url"), F.col(html).alias("html")
    )
    pages = pages.repartition(tasks) if tasks else pages
    names = ["page_id", "extractor_id", "ord", *FIELDS, "attrs", "record_size", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page in batch.itertuples(index=False):
                try:
                    parse = parsers.get(page.extractor_id)
                    if parse is None:
                        raise LookupError(f"no parser for {page.extractor_id}")
                    for n, record in enumerate(parse(page.html, page.url) or []):
                        record = record if isinstance(record, dict) else {}
                        given = [None if record.get(f) is None else str(record[f]) for f in FIELDS]
                        extra = {k: str(v) for k, v in record.items() if k not in FIELDS and v is not None}
                        out.append((page.page_id, page.extractor_id, n, *given, extra, len(record), None))
                except Exception as e:
                    blank = [None] * len(FIELDS)
                    out.append((page.page_id, page.extractor_id, -1, *blank, {}, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names)

    schema = f"page_id {id_type}, extractor_id string, ord int, {RECORD}, attrs map<string,string>, record_size int, error string"
    rows = pages.mapInPandas(run, schema)
    errors = rows.filter("error IS NOT NULL").select("page_id", "extractor_id", "error")
    return rows.filter("error IS NULL").drop("error"), errors


def ensure_source_url(records: DataFrame, page_url: Column) -> DataFrame:
    return records.withColumn("source_url", F.coalesce(blank_to_null(F.col("source_url")), page_url))


def valid_records(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: status, valid record count and discarded count.

    ``records`` has ``record_size``: the number of keys, 0 or null for anything that is not
    a non-empty record.
    """
    valid = F.count_if(F.coalesce(F.col("record_size"), F.lit(0)) > 0)
    return records.groupBy(*keys).agg(
        F.when(valid > 0, "SUCCESS").otherwise("ZERO_ROWS").alias("status"),
        valid.alias("items_scraped"),
        (F.count("*") - valid).alias("discarded"),
    )


def fetch_outcome(http_status: Column, items: Column) -> Column:
    """Run status of a single fetch."""
    return (
        F.when(items > 0, "SUCCESS").when(http_status == 200, "ZERO_ROWS").otherwise("FAILED")
    )


def run_outcomes(fetches: DataFrame, key: str) -> DataFrame:
    """Run log rows from fetch rows (``status_code, has_content, items``), one per run."""
    page_ok = (F.col("status_code") == 200) & F.col("has_content")
    items = F.coalesce(F.sum(F.when(page_ok, F.col("items").cast("long"))), F.lit(0))
    ok = F.count_if(page_ok)
    return fetches.groupBy(key).agg(
        F.when(items > 0, "SUCCESS").when(ok > 0, "ZERO_ROWS").otherwise("FAILED").alias("status"),
        items.alias("items_scraped"),
        ok.alias("http_200_count"),
        F.count_if(F.col("status_code") == 403).alias("http_403_count"),
        F.count_if(F.col("status_code") == 429).alias("http_429_count"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
