"""Logical tables derived from the given Parquet tables, whole table to whole table.

``checks.oracles`` derives the same tables in SQL.
"""

from __future__ import annotations

import gzip
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.session import resolved

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{AS_OF}'")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The run log: 20 bundles; 17 is idle in the last days, 19 never succeeds."""
    e = table(spark, sf, "events")
    slot = F.col("user_id") % 20
    kind = F.col("event_type")
    success = kind.isin("purchase", "signup")
    status = (
        F.when(success & (slot == 19), "ZERO_ROWS")
        .when(success, "SUCCESS")
        .when(kind == "view", "ZERO_ROWS")
        .when(kind == "click", "DEGRADED")
        .otherwise("FAILED")
    )
    failed = kind == "error"
    zero = F.lit(0)
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("bundle_"), F.lpad(slot.cast("string"), 2, "0")).alias("bundle_name"),
        status.alias("status"),
        F.when(status == "SUCCESS", F.floor("value").cast("int")).otherwise(zero).alias("items_scraped"),
        F.col("value").cast("decimal(8,2)").alias("duration_seconds"),
        F.when(failed, zero).otherwise(1).alias("http_200_count"),
        F.when(failed & (_k() % 2 == 0), _k()).otherwise(zero).alias("http_403_count"),
        F.when(failed & (_k() % 2 == 1), _k()).otherwise(zero).alias("http_429_count"),
        zero.alias("http_500_count"),
        F.when(failed, F.concat(F.lit("KeyError: k="), _k().cast("string"))).alias("error_message"),
        F.when(slot == 17, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts")).alias("created_at"),
    )


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """25 known bundles, five of which never run."""
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return table(spark, sf, "nation").select(F.concat(F.lit("bundle_"), key).alias("bundle_name"))


def settings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("bundle_"), F.lpad(n.cast("string"), 2, "0")).alias("bundle_name"),
        F.when(n % 2 == 0, 6).alias("sla_hours"),
        F.when(n % 3 == 0, F.lit(0.6)).alias("anomaly_ratio"),
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Process log: one line per event; every tenth error names no bundle path."""
    e = table(spark, sf, "events")
    slot = F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")
    path = F.when(F.col("event_id") % 10 == 0, F.lit("scheduler")).otherwise(
        F.concat(F.lit("bundles/bundle_"), slot, F.lit("/scraper.py"))
    )
    text = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit("  [ERROR] KeyError in "), path, F.lit(" k="), _k().cast("string")),
    ).otherwise(F.concat(F.lit("INFO finished "), path))
    return e.select(F.col("event_id").alias("ord"), text.alias("value"))


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """The process log as files of 500 lines: ``file, line, value``."""
    ord = F.col("ord")
    return log_lines(spark, sf).select(F.floor(ord / 500).alias("file"), (ord % 500 + 1).alias("line"), "value")


def write_logs(lines: DataFrame, root: str) -> None:
    """Writes the files, each anew, by the tasks that hold their lines."""
    folder = root.removeprefix("file://").removeprefix("file:")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        rows = rows.sort_values("line")
        path = f"{folder}/{rows['file'].iloc[0]}.log"
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            f.writelines(v + "\n" for v in rows["value"])
        os.replace(f"{path}.new", path)
        return pd.DataFrame({"n": [len(rows)]})

    lines.groupBy("file").applyInPandas(write, "n long").agg(F.sum("n")).collect()


def write_arrays(rows: DataFrame, path: str) -> None:
    """One JSON array per file, an element per line."""

    def lines(batches):
        mark = "["
        for batch in batches:
            yield pd.DataFrame({"value": [f"{mark if i == 0 else ','}{v}" for i, v in enumerate(batch["value"])]})
            mark = ","
        yield pd.DataFrame({"value": ["[]" if mark == "[" else "]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(lines, "value string").write.text(path)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "user_id",
        F.when(F.col("event_type") != "error", 200)
        .when(_k() % 2 == 0, 403)
        .otherwise(429)
        .alias("status_code"),
    )


def run_states(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.when(kind == "view", "STARTED")
        .when(kind == "click", "QUEUED")
        .when(kind == "signup", "STARTING")
        .otherwise("SUCCESS")
        .alias("status"),
        F.col("ts").alias("updated_at"),
    )


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch rows of a run per user: status, whether a body came, items parsed."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") != "error", 200).when(_k() % 2 == 0, 403).otherwise(429).alias("status_code"),
        (F.col("event_type") != "view").alias("has_content"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("int")).otherwise(0).alias("items"),
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """A raw supplier feed of text columns with padding, bad numbers and wrong check digits."""
    p = F.col("p_partkey")
    base = F.lpad(p.cast("string"), 12, "0")
    total = F.lit(0)
    for i in range(1, 13):
        total = total + F.substring(base, i, 1).cast("int") * (3 if i % 2 == 0 else 1)
    check = (10 - total % 10) % 10
    check = F.when(p % 5 == 4, (check + 1) % 10).otherwise(check)
    price = F.col("p_retailprice")
    return table(spark, sf, "part").select(
        p.alias("row_id"),
        F.when(p % 97 == 96, "").otherwise(F.concat(F.lit("\t SKU-"), p.cast("string"), F.lit("\u00a0"))).alias("sku"),
        F.when(p % 11 != 10, F.concat(base, check.cast("string"))).alias("gtin"),
        F.when(p % 4 == 3, F.lit(None)).when(p % 23 == 22, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("brand"),
        F.concat(F.lit(" "), F.col("p_name")).alias("title"),
        F.when(p % 7 != 6, F.col("p_type")).alias("category"),
        F.when(p % 29 == 28, "n/a")
        .when(p % 13 == 12, "0")
        .when(p % 17 == 16, (price * 1000).cast("string"))
        .when(p % 19 != 18, price.cast("string"))
        .alias("price"),
        F.when(p % 31 == 30, "many").otherwise((F.col("p_size") - 3).cast("string")).alias("stock"),
    )


def awkward_titles(feed: DataFrame) -> DataFrame:
    """The feed with titles that CSV must quote: quotes, commas, line breaks and padding."""
    p = F.col("row_id")
    tail = F.when(p % 5 == 0, ' 5" screw, "best"').when(p % 5 == 1, "\nsecond, line").when(p % 5 == 2, ' \\ "').when(p % 5 == 3, "  ,  ").otherwise("")
    return feed.withColumn("title", F.concat("title", tail))


# Word lists for the test feed: the default ones do not occur in it.
ALIASES = {f"brand#{k}": f"Brand#{k}" for k in (1, 2, 3, 4, 5)} | {"widget": "Widgetco"}
KEYWORDS = [("bolt", "Hardware > Bolts"), ("ring", "Hardware > Rings")]


def dirty_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Product labels with swapped tokens and extra spaces."""
    p, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    return table(spark, sf, "part").select(
        p.alias("ord"),
        F.when(p % 3 == 0, F.concat(name, F.lit(" "), brand))
        .when(p % 3 == 1, F.concat(brand, F.lit("  "), name))
        .otherwise(F.concat(F.lit(" "), name, F.lit(" "), brand, F.lit(" ")))
        .alias("label"),
    )


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            ("blog-tionsh", ["blog.tionsh.example.net", "example.org"]),
            ("com_site", ["Example.com"]),
            ("net_site", ["example.net", "blog.tionsh.example.net"]),
        ],
        "extractor_id string, domains array<string>",
    )


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Routed listing pages: headings, cards and items, with and without a paragraph beside them."""
    p = F.col("page_id").cast("string")
    more = F.transform(
        F.sequence(F.lit(1), (F.col("page_id") % 3 + 1).cast("int")),
        lambda i: F.concat(F.lit("<section><h1>Extra "), i.cast("string"), F.lit("</h1>\n<p>About <i>"), p, F.lit("</i></p><p>Not this</p></section>")),
    )
    html = F.concat(
        F.lit("<html><body><div><h2>Shop "), p, F.lit("</h2><p>First <b>note</b> "), p, F.lit("</p></div><h3>A</h3>"),
        F.lit('<div><div class="card big">Card <em>'), p, F.lit("</em></div><span>x</span><p>Second &amp; note</p></div>"),
        F.lit('<ul><li class="item"><script>var a;</script>Item '), p, F.lit("</li></ul>"), F.array_join(more, ""), F.lit("</body></html>"),
    )
    return table(spark, sf, "pages").select("page_id", F.lit("com_site").alias("extractor_id"), "url", html.alias("html"))


def capture_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Capture JSON lines, one per page; every 50th is malformed."""
    p = F.col("page_id")
    line = F.to_json(
        F.struct(
            "url",
            F.concat(F.lit("crawl-data/part-"), (p % 10).cast("string"), F.lit(".warc.gz")).alias("filename"),
            (p * 1000).cast("string").alias("offset"),
            F.when(p % 11 != 10, F.length("html").cast("string")).alias("length"),
            F.when(p % 7 == 0, "404").when(p % 7 == 1, "-").otherwise("200").alias("status"),
            F.when(p % 5 == 0, "application/pdf").otherwise("text/html").alias("mime"),
            F.when(p % 3 == 0, "text/html; charset=utf-8").alias("mime-detected"),
            F.concat(F.lit("20240101"), F.lpad(p.cast("string"), 6, "0")).alias("timestamp"),
        )
    )
    return table(spark, sf, "pages").select(
        p.alias("ord"), F.when(p % 50 == 49, F.lit("{broken")).otherwise(line).alias("value")
    )


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a crawl URL index with its partition columns."""
    p = F.col("page_id")
    return table(spark, sf, "pages").select(
        "url",
        F.lower(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("url_host_name"),
        F.when(p % 7 == 0, 404).otherwise(200).cast("short").alias("fetch_status"),
        F.when(p % 5 == 0, "application/pdf").otherwise("text/html").alias("content_mime_type"),
        F.concat(F.lit("crawl-data/part-"), (p % 10).cast("string"), F.lit(".warc.gz")).alias("warc_filename"),
        (p * 1000).alias("warc_record_offset"),
        F.length("html").cast("long").alias("warc_record_length"),
        F.when(p % 2 == 0, "CC-MAIN-2024-46").otherwise("CC-MAIN-2024-51").alias("crawl"),
        F.when(p % 3 == 0, "crawldiagnostics").otherwise("warc").alias("subset"),
    )


def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        F.concat(
            F.lit("cc-index/table/cc-main/warc/crawl="),
            F.when(F.col("page_id") % 2 == 0, "CC-MAIN-2024-46").otherwise("CC-MAIN-2024-51"),
            F.lit("/subset="),
            F.when(F.col("page_id") % 3 == 0, "crawldiagnostics").otherwise("warc"),
            F.lit("/part-"), F.lpad(p, 9, "0"),
            F.when(F.col("page_id") % 9 == 8, ".json").otherwise(".parquet"),
        ).alias("value"),
    )


def archive_pointers(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """Write the pages as archive files of gzip members; return a pointer per page.

    A file takes 32 pages of consecutive ids. Some pages carry a request record before the
    response, every 40th a request only, every 25th pointer has no length, and pages that
    fit are stored as Latin-1.
    """

    uri = resolved(spark, root)

    def write(pages: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        pages = pages.sort_values("page_id")
        name = f"segment-{int(pages['page_id'].iloc[0]) // 32:06d}.warc.gz"
        store.create_dir(base, recursive=True)
        rows, at = [], 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for page in pages.itertuples(index=False):
                data = b""
                for kind in ("request", "response"):
                    if kind == "request" and page.page_id % 4 and page.page_id % 40 != 39:
                        continue
                    if kind == "response" and page.page_id % 40 == 39:
                        continue
                    try:
                        charset, body = "iso-8859-1", page.html.encode("iso-8859-1")
                    except UnicodeEncodeError:
                        charset, body = "utf-8", page.html.encode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + body
                    if kind == "request":
                        http = b"GET / HTTP/1.1\r\nHost: example\r\n\r\n"
                    head = (
                        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {page.url}\r\n"
                        f"Content-Length: {len(http)}\r\n\r\n"
                    ).encode()
                    data += gzip.compress(head + http + b"\r\n\r\n", mtime=0)
                out.write(data)
                size = 0 if page.page_id % 25 == 24 else len(data)
                rows.append((page.page_id, page.url, name, at, size))
                at += len(data)
        return pd.DataFrame(
            rows, columns=["page_id", "url", "warc_filename", "warc_record_offset", "warc_record_length"]
        )

    pages = table(spark, sf, "pages")
    return pages.groupBy(F.floor(F.col("page_id") / 32).alias("file")).applyInPandas(
        write,
        "page_id long, url string, warc_filename string, warc_record_offset long, warc_record_length long",
    )


def raw_websites(spark: SparkSession, sf: str) -> DataFrame:
    p, url = F.col("page_id"), F.col("url")
    wrapped = F.concat(
        F.lit("https://r.example/redirect?x=1&u="), F.url_encode(url), F.lit("&utm=feed#frag")
    )
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(p % 45 == 44, F.lit(""))
        .when(p % 6 == 0, wrapped)
        .when(p % 10 == 1, F.regexp_replace(url, "^https?://", ""))
        .when(p % 15 == 2, F.concat(F.lit("\u200b "), url, F.lit("\u00a0")))
        .otherwise(url)
        .alias("raw"),
    )


def leads(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(s % 10 == 0, "4.8.1")
        .when(s % 10 == 1, F.lit(None))
        .when(s % 10 == 2, "")
        .when(s % 10 == 3, "4.9 stars")
        .when(s % 10 == 4, "4.5/")
        .when(s % 10 == 5, "n/a")
        .otherwise(F.concat(F.lit("4."), (s % 10).cast("string")))
        .alias("rating"),
        F.when(s % 13 != 12, s % 47).cast("int").alias("reviews"),
        F.when(s % 5 == 0, "$250,000+")
        .when(s % 5 == 1, "$10,000+")
        .when(s % 5 == 2, "$100,000")
        .when(s % 5 == 3, "$5,000")
        .alias("project_size"),
    )


def items_current(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("id"),
        F.col("s_name").alias("company_name"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("summary"),
        F.concat(F.lit("https://example.com/s/"), s.cast("string")).alias("source_url"),
        (F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_interval(mins=s.cast("int"))).alias("created_at"),
    )


def items_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as a batch: ten rows per key, two thirds of the keys known."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("pos"),
        F.concat(F.lit("Supplier#"), F.lpad(F.floor(c / 10).cast("string"), 9, "0")).alias("company_name"),
        F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("summary"),
        F.concat(F.lit("https://example.com/c/"), c.cast("string")).alias("source_url"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label, the mean of its points."""
    parts = points(spark, sf).select("label", F.posexplode("vector").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector")
    ).select(F.col("label").alias("query_id"), "vector")


def media(spark: SparkSession, sf: str) -> DataFrame:
    turn, role, text = F.col("turn"), F.col("role"), F.col("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("cluster_id"),
        turn.alias("ord"),
        F.when(role == "assistant", "image").when(role == "user", "video").alias("type"),
        F.when(turn % 3 == 1, text).otherwise("").alias("title"),
        F.when((role == "assistant") & (turn % 2 == 1), text).alias("speech_transcript"),
        F.when(role == "user", text).otherwise("  ").alias("ocr_text"),
        F.when(turn % 2 == 0, role).otherwise("").alias("brand"),
    )
