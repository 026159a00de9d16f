"""Index shards, captures and archive records."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sitemill.sources import archive, crawl, feeds


def test_locations():
    assert crawl.manifest_url("CC-X") == "https://data.commoncrawl.org/crawl-data/CC-X/cc-index-table.paths.gz"
    assert crawl.partition_glob("CC-X") == (
        "s3://commoncrawl/cc-index/table/cc-main/warc/crawl=CC-X/subset=warc/*.parquet"
    )


def test_shards(spark, tmp_path):
    lines = ["", "x/crawl=C1/subset=warc/b.parquet ", "/x/crawl=C1/subset=warc/a.parquet", "x/crawl=C1/subset=robots/z.parquet",
             "x/crawl=C2/subset=warc/c.parquet", "x/crawl=C1/subset=warc/d.json", "x/crawl=C1/subset=warc/e.parquet"]
    path = tmp_path / "cc-index-table.paths.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))

    def listed(**kw):
        return [r[0] for r in crawl.shards(spark, str(path), "C1", **kw).collect()]

    assert listed(max_shards=2) == ["x/crawl=C1/subset=warc/b.parquet", "x/crawl=C1/subset=warc/a.parquet"]
    assert len(listed(max_shards=None)) == len(listed(max_shards=0)) == 3
    assert listed(max_shards=1, base="https://h")[0] == "https://h/x/crawl=C1/subset=warc/b.parquet"
    with pytest.raises(RuntimeError):
        crawl.shard_paths(crawl.shards(spark, str(path), "C9"))


def test_index_prunes_partitions_and_columns(spark, tmp_path):
    root = str(tmp_path / "idx")
    rows = [("https://a.example/", "a.example", 200, "text/html", "f", 0, 1, c, s) for c in ("C1", "C2") for s in ("warc", "robots")]
    spark.createDataFrame(rows, crawl.INDEX_SCHEMA).write.partitionBy("crawl", "subset").parquet(root)
    crawl.index(spark, root)
    df = crawl.query_index(spark, "SELECT url FROM cc WHERE crawl = 'C1' AND subset = 'warc' AND fetch_status = 200")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crawl" in plan and "EqualTo(fetch_status,200)" in plan
    assert "ReadSchema: struct<url:string,fetch_status:smallint" in plan and "content_mime_type" not in plan
    assert df.count() == 1
    one = crawl.index(spark, root, [f"{root}/crawl=C2/subset=warc"], view=None)
    assert [(r["crawl"], r["subset"]) for r in one.collect()] == [("C2", "warc")]


def capture(**kw):
    base = {"url": "https://A.example:80/", "filename": "crawl-data/x.warc.gz", "offset": "1", "length": "10", "status": "200", "mime": "text/html"}
    return json.dumps({k: v for k, v in (base | kw).items() if v is not None})


def captures(spark, lines, **kw):
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, value string")
    return crawl.cdx_captures(df, **kw).collect()


def test_captures(spark):
    (r,) = captures(spark, [capture(), "", "   ", "{bad", "No Captures found"])
    assert r["warc_filename"] == "crawl-data/x.warc.gz" and r["url_host_name"] == "a.example"
    assert (r["warc_record_offset"], r["warc_record_length"], r["status"], r["source"]) == (1, 10, 200, "cdx")


def test_capture_filters(spark):
    lines = [
        capture(status="404"),
        capture(mime="application/pdf"),
        capture(mime="application/pdf", **{"mime-detected": "text/html"}),
        capture(mime="text/html", **{"mime-detected": "image/png"}),
        capture(filename=""),
        capture(offset=None),
        capture(status="-"),
    ]
    assert len(captures(spark, lines)) == 1
    free = captures(spark, lines, status=None, mime=None)
    assert len(free) == 5 and {r["status"] for r in free} == {200, 404, None}
    assert captures(spark, ["{}"] , status=None, mime=None) == []


def test_capture_limit_over_fetches_five_times(spark):
    lines = [capture(status="404")] * 4 + [capture(url=f"https://x.example/{i}") for i in range(10)]
    got = captures(spark, lines, limit=1, order="ord", service_limits=True)
    assert [r["url"] for r in got] == ["https://x.example/0"]
    assert captures(spark, [capture(status="404")] * 5 + lines, limit=1, order="ord", service_limits=True) == []
    assert len(captures(spark, lines, limit=0, order="ord", service_limits=True)) == 1
    assert len(captures(spark, [capture(status="404")] * 50 + lines, limit=7, order="ord")) == 7


def test_dropped_captures_are_counted(spark):
    df = spark.createDataFrame([(x,) for x in (capture(), "", "  ", "{bad", "No Captures found", None)], "value string")
    assert tuple(crawl.dropped_captures(df).first()) == (6, 3, 2)


def record(kind="response", body=b"hi", head=b"Content-Type: text/html", uri="http://x/"):
    http = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    warc = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    return warc + http + b"\r\n\r\n"


def test_read_response_forms():
    two = gzip.compress(record("request")) + gzip.compress(record(body=b"second"))
    assert archive.read_response(two)["body"] == b"second"
    assert archive.read_response(record("warcinfo") + record(body=b"plain"))["body"] == b"plain"
    r = archive.read_response(gzip.compress(record(body="é".encode("latin-1"), head=b"Content-Type: text/html; charset=ISO-8859-1; x=1")))
    assert (r["text"], r["charset_fallback"], r["status"]) == ("é", False, 200)
    r = archive.read_response(record(body=b"\xff", head=b"Content-Type: text/html; charset=nope"))
    assert (r["text"], r["charset_fallback"]) == ("�", True)
    chunked = archive.read_response(record(body=b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", head=b"Transfer-Encoding: chunked"))
    assert chunked["body"] == b"abcde"
    assert archive.read_response(record(body=gzip.compress(b"z"), head=b"Content-Encoding: gzip"))["body"] == b"z"
    with pytest.raises(ValueError):
        archive.read_response(gzip.compress(record("request")))


def test_archive_records(spark, tmp_path):
    parts = [gzip.compress(record(uri=f"http://x/{i}", body=str(i).encode())) for i in range(4)] + [gzip.compress(record("request"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    ends = [sum(map(len, parts[: i + 1])) for i in range(5)]
    rows = [(i, "a.warc.gz", ends[i] - len(parts[i]), len(parts[i])) for i in range(5)]
    rows += [(5, "a.warc.gz", 0, 0), (6, "a.warc.gz", -1, 5), (7, "missing.warc.gz", 0, 5), (8, "a.warc.gz", 1, 9)]
    pointers = spark.createDataFrame(rows, "id int, warc_filename string, warc_record_offset long, warc_record_length long")
    ok, bad = archive.archive_records(pointers, str(tmp_path))
    got = {r["id"]: (r["target_uri"], bytes(r["body"]), r["headers"]) for r in ok.collect()}
    assert got == {i: (f"http://x/{i}", str(i).encode(), {"Content-Type": "text/html"}) for i in range(4)}
    errors = {r["id"]: r["error"] for r in bad.collect()}
    assert set(errors) == {4, 5, 6, 7, 8} and "no response record" in errors[4]
    # The limit takes pointers, before failures are dropped.
    ok, bad = archive.archive_records(pointers.filter("id >= 3"), f"file://{tmp_path}", limit=2, order="id")
    assert [r["id"] for r in ok.collect()] == [3] and [r["id"] for r in bad.collect()] == [4]


def test_hot_archive_is_spread_over_tasks(spark):
    pointers = spark.range(4000).select(
        F.lit("one.warc.gz").alias("warc_filename"),
        (F.col("id") * 1_000_000).alias("warc_record_offset"),
        F.lit(10).cast("long").alias("warc_record_length"),
    )
    spread = pointers.repartition(8, "warc_filename", F.floor(F.col("warc_record_offset") / archive.RANGE_BYTES))
    assert spread.select(F.spark_partition_id()).distinct().count() > 4


def test_payloads(spark, tmp_path):
    path = str(tmp_path / "p")
    feeds.write_payloads(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    assert feeds.read_payloads(spark, path, "a int, b string").first()["b"] == "x"
    (tmp_path / "q.json").write_text('{"a": 1}\n[1, 2\n')
    with pytest.raises(Exception, match="not a JSON object"):
        feeds.read_payloads(spark, str(tmp_path / "q.json"), "a int").collect()


def test_record_runs(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("demo", "SUCCESS", 3)], "bundle_name string, status string, items_scraped int")
    assert feeds.record_runs(runs, root, "a") and not feeds.record_runs(runs.limit(0), root, "b")
    r = feeds.read_log(spark, root).first()
    assert (r["http_403_count"], r["items_scraped"], float(r["duration_seconds"])) == (0, 3, 0.0) and r["created_at"]
    assert feeds.read_telemetry(spark, root).count() == 1
