"""Registered queries: operators wired to the logical tables."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters as A
from sitemill.functions import scoring, text
from sitemill.operators import ballsearch, cluster, extract, fuzzy, lookup, media, merge, routing, store, vectors
from sitemill.operators.ranking import number_rows
from sitemill.plans import alerts, catalog, health, report, snapshot
from sitemill.session import materialize, scratch_path, tune
from sitemill.sources import archive, crawl, feeds
from sitemill.streaming import health as stream_jobs
from sitemill.streaming import logs as stream_logs
from sitemill.streaming import logtail

QUERIES = {}


def query(fn):
    def run(spark: SparkSession, sf: str, **options) -> DataFrame:
        return fn(tune(spark), sf, **options)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


# Observability


def _health(spark, sf, logs=False):
    errors = health.log_error_summary(health.log_errors(A.log_lines(spark, sf))) if logs else None
    return health.status(
        health.rollup(A.runs(spark, sf), A.as_of()), A.as_of(), A.bundles(spark, sf), A.settings(spark, sf), errors
    )


@query
def health_rollup_24h(spark, sf):
    return health.rollup(A.runs(spark, sf), A.as_of())


@query
def health_rollup_idle(spark, sf):
    return health.rollup(A.runs(spark, sf), A.as_of(), include_idle=True)


@query
def health_status(spark, sf):
    return _health(spark, sf).select(
        "bundle_name",
        "status",
        "total_runs_24h",
        "success_runs_24h",
        F.col("total_items_scraped_24h").alias("items_scraped_24h"),
        (F.col("last_success") == "Never").alias("never"),
        F.round("hours_since_success", 4).alias("hours_since_success"),
        "sla_hours",
        F.round("anomaly_ratio", 2).alias("anomaly_ratio"),
        "stdout_error_count",
        F.size("issues").alias("issues_n"),
    )


@query
def health_status_logs(spark, sf):
    return _health(spark, sf, logs=True).select("bundle_name", "status", "first_error", "stdout_error_count")


@query
def health_report(spark, sf):
    """The report's rows by bundle name, with their places."""
    rows = health.report(_health(spark, sf)).select("bundle_name", "status", "total_runs_24h")
    return number_rows(rows, ["bundle_name"], "place", F.lit(0))


@query
def health_issues(spark, sf):
    return health.issues(_health(spark, sf, logs=True))


@query
def health_fleet(spark, sf):
    return health.fleet(_health(spark, sf))


@query
def health_fleet_action(spark, sf):
    return health.fleet_action(health.fleet(_health(spark, sf)))


@query
def health_digest(spark, sf):
    wanted = A.bundles(spark, sf).withColumn("bundle_exists", F.lit(True))
    d = health.digest(_health(spark, sf), A.runs(spark, sf), wanted)
    return d.select(
        "bundle_name",
        "status",
        "action",
        "runs_24h",
        "success_24h",
        "items_24h",
        F.size("issues").alias("issues_shown"),
        F.array_join("issues", " / ").alias("issue_texts"),
        F.col("last_log.status").alias("last_status"),
        F.col("last_log.error_message").alias("last_error"),
        F.col("last_log.created_at").alias("last_at"),
        "next",
    )


@query
def last_run(spark, sf):
    return health.last_runs(A.runs(spark, sf)).select(
        "bundle_name", "id", "status", "items_scraped", "http_403_count", "http_429_count", "error_message", "created_at"
    )


@query
def last_failure(spark, sf):
    return health.last_failures(A.runs(spark, sf)).select("bundle_name", "id", "status", "error_message", "created_at")


@query
def diagnostics(spark, sf):
    return health.diagnostics(A.runs(spark, sf), A.bundles(spark, sf))


@query
def failure_mode(spark, sf):
    mode = health.failure_mode(*[F.col(c) for c in ("status", "http_403_count", "http_429_count", "error_message")])
    return A.runs(spark, sf).select("id", "bundle_name", mode.alias("mode"))


@query
def probe_ratio(spark, sf):
    return health.probe_health(A.probes(spark, sf), ["user_id"])


@query
def stuck_runs(spark, sf):
    return health.stuck_runs(A.run_states(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'"))


@query
def run_outcomes(spark, sf):
    return extract.run_outcomes(A.fetches(spark, sf), "run_id")


@query
def fetch_outcomes(spark, sf):
    f = A.fetches(spark, sf)
    status = extract.fetch_outcome(F.col("status_code"), F.col("items"))
    return f.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query
def log_errors(spark, sf):
    return health.log_errors(A.log_lines(spark, sf))


def _alerts(spark, sf):
    return alerts.degradation_alerts(health.issues(_health(spark, sf, logs=True)), A.as_of())


@query
def alert_rows(spark, sf):
    return _alerts(spark, sf)


@query
def alerts_fanout(spark, sf):
    channels = [
        ("chat", "room-1"),
        ("chat_webhook", "https://hooks.example/a"),
        ("webhook", "https://hooks.example/b"),
        ("webhook", "https://hooks.example/b"),
    ]
    return alerts.fan_out(_alerts(spark, sf), channels, A.as_of()).select("bundle_name", "alert_type", "channel", "target", "body")


@query
def attention_alerts(spark, sf):
    failed = health.last_failures(A.runs(spark, sf)).select(
        "bundle_name", F.lit(3).alias("retries_count"), F.coalesce("error_message", "status").alias("last_error")
    )
    return alerts.attention_alerts(failed, A.as_of())


@query
def repair_alerts(spark, sf):
    repaired = A.runs(spark, sf).groupBy("bundle_name").agg(
        F.lit("model").alias("model_used"), F.lit(1).alias("attempt"), F.count("*").alias("modified_lines_count")
    )
    return alerts.repair_alerts(repaired, A.as_of())


@query
def run_log_append(spark, sf):
    """Runs appended to log and telemetry, read back from telemetry."""
    root = scratch_path(spark, "runlog")
    for batch in (0, 1, 1):  # the second is tried again
        feeds.record_runs(A.runs(spark, sf).where(F.col("id") % 2 == batch), root, f"{batch:04d}")
    log, telemetry = feeds.read_log(spark, root), feeds.read_telemetry(spark, root)
    per_day = telemetry.groupBy(F.col("dt").cast("string").alias("dt"), "status").agg(
        F.count("*").alias("runs"), F.sum("items_scraped").alias("items"),
        F.sum("duration_seconds").cast("double").alias("seconds"),
    )
    logged = log.groupBy(F.col("dt").cast("string").alias("dt"), "status").agg(F.count("*").alias("logged"))
    return per_day.join(logged, ["dt", "status"])


# Catalog


def _enriched(spark, sf):
    return catalog.enrich(catalog.normalize(A.feed(spark, sf)), _rules())


def _rules():
    return catalog.rule_pack(A.ALIASES, keywords=A.KEYWORDS)


@query
def feed_profile(spark, sf):
    return catalog.profile(A.feed(spark, sf))


@query
def feed_normalized(spark, sf):
    return catalog.normalize(A.feed(spark, sf))


@query
def feed_csv_scan(spark, sf):
    """Titles with doubled quotes, commas, line breaks and padding, written and read as CSV."""
    path = scratch_path(spark, "feed") + ".csv"
    feeds.export_csv(A.awkward_titles(A.feed(spark, sf)), path)
    return catalog.normalize(feeds.read_feed(spark, path)).withColumn("row_id", F.col("row_id").cast("long"))


@query
def feed_json_scan(spark, sf):
    path = scratch_path(spark, "feed") + ".json"
    A.feed(spark, sf).write.json(path)
    return catalog.profile(feeds.read_feed(spark, path, A.feed(spark, sf).schema))


@query
def feed_array_scan(spark, sf):
    """The feed as files of one JSON array each, read by ranges."""
    path = scratch_path(spark, "feed") + ".json"
    A.write_arrays(A.feed(spark, sf), path)
    return catalog.normalize(feeds.read_feed(spark, path, A.feed(spark, sf).schema, array=True))


@query
def gtin_check(spark, sf):
    f = catalog.normalize(A.feed(spark, sf))
    f = f.select("row_id", scoring.digits(F.col("gtin")).alias("digits"))
    f = f.withColumn("number", F.col("digits").try_cast("bigint"))
    return f.withColumn("valid", scoring.gtin_valid("digits", "number")).drop("number")


@query
def rule_predictions(spark, sf):
    rows = catalog.prediction_rows(_enriched(spark, sf), "row_id")
    # Prices are compared as numbers: their text differs between engines.
    number = F.when(F.col("field") == "price", F.round(F.col("value").try_cast("double"), 4))
    value = F.when(F.col("field") != "price", F.col("value"))
    return rows.select("row_id", "rule_id", value.alias("value"), number.alias("number"), "confidence", "message")


@query
def catalog_enriched(spark, sf):
    e = _enriched(spark, sf)
    return e.select(
        "row_id", "sku", "gtin", "brand", "title", "color", "category", F.round("price", 4).alias("price"), "stock",
        F.array_join(F.transform("low_conf", lambda p: p["rule_id"]), ",").alias("low_conf"), "quarantine",
    )


@query
def quarantine_split(spark, sf):
    clean, held = catalog.split(materialize(_enriched(spark, sf), "enriched"))
    return clean.select("row_id", F.lit("clean").alias("part")).unionByName(
        held.select("row_id", F.lit("quarantine").alias("part"))
    )


@query
def rule_hits(spark, sf):
    return catalog.rule_hits(_enriched(spark, sf), _rules())


@query
def qa_issues(spark, sf):
    found = catalog.issues(_enriched(spark, sf))
    return found.select("sku", "field", "severity", "message")


@query
def qa_rollup(spark, sf):
    return catalog.rollup(_enriched(spark, sf))


@query
def qa_gate(spark, sf):
    return catalog.gate(catalog.rollup(_enriched(spark, sf)))


@query
def catalog_export(spark, sf):
    """The whole catalog job on rows that can pass the gate; the exported files counted."""
    out = scratch_path(spark, "catalog")
    feed = A.awkward_titles(A.feed(spark, sf)).withColumns(
        {"price": F.when(F.col("price") == "0", F.lit(None)).otherwise(F.col("price")),
         "stock": F.lit("1"), "sku": F.concat(F.lit("SKU-"), F.col("row_id").cast("string"))}
    )
    catalog.run(feed, out, "feed.csv", rules=_rules())
    parts = [
        feeds.read_feed(spark, f"{out}/{n}.csv").select(F.lit(n).alias("part"), "sku", "title") for n in ("catalog", "quarantine")
    ]
    ledger = catalog.stored(spark, out, "import_runs")
    ledger = ledger.select(F.col("status").alias("part"), F.col("row_count").cast("string").alias("sku"), F.lit(None).cast("string").alias("title"))
    return parts[0].unionByName(parts[1]).unionByName(ledger)


@query
def staging_rows(spark, sf):
    return catalog.staging(_enriched(spark, sf), 7).select("import_run_id", "row_id", "qa_status", "row_hash")


@query
def brand_map_apply(spark, sf):
    part = A.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    known = part.groupBy("brand").agg(F.count("*").alias("n"))
    mapping = known.filter("n > 0").select(
        F.col("brand").alias("raw"),
        F.when(F.length("brand") == 7, F.concat(F.lit("House "), F.substring("brand", 7, 1))).alias("canonical"),
    )
    return lookup.apply_map(part, mapping)


@query
def keyword_category(spark, sf):
    """Titles against a dictionary of every second word in the catalog."""
    part = A.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"))
    word = F.element_at(F.split("p_name", " "), -1)
    words = A.table(spark, sf, "part").select(F.lower(F.substring(word, 1, 3)).alias("needle")).distinct()
    needles = words.select(
        "needle", F.concat(F.lit("Parts > "), "needle").alias("value"), F.col("needle").alias("rank")
    )
    return lookup.first_contained(part, "title", needles, "category")


@query
def brand_canonical(spark, sf):
    return fuzzy.canonicalize(A.dirty_labels(spark, sf), "label", "ord")


# Crawl


def _index(spark, sf):
    root = scratch_path(spark, "index")
    A.index_rows(spark, sf).write.partitionBy("crawl", "subset").parquet(root)
    return crawl.index(spark, root)


@query
def index_scan(spark, sf):
    return _index(spark, sf).select(
        "url", "url_host_name", "fetch_status", "content_mime_type", "warc_filename", "warc_record_offset",
        "warc_record_length", "crawl", "subset", F.col("source_file").rlike("/crawl=.*/subset=.*[.]parquet$").alias("has_file"),
    )


@query
def index_query(spark, sf):
    _index(spark, sf)
    return crawl.query_index(
        spark,
        """
        SELECT url_host_name, count(*) AS captures, sum(warc_record_length) AS bytes
        FROM cc
        WHERE crawl = 'CC-MAIN-2024-46' AND subset = 'warc'
          AND fetch_status = 200 AND content_mime_type LIKE 'text/html%'
        GROUP BY url_host_name
        """,
    )


@query
def shard_list(spark, sf):
    path = scratch_path(spark, "manifest")
    lines = A.manifest_lines(spark, sf).repartitionByRange("page_id").sortWithinPartitions("page_id")
    lines.select("value").write.option("compression", "gzip").text(path)
    return crawl.shards(spark, path, "CC-MAIN-2024-46")


@query
def shard_limit(spark, sf):
    """The first shards of a manifest, in its order."""
    path = scratch_path(spark, "manifest")
    lines = A.manifest_lines(spark, sf).repartitionByRange("page_id").sortWithinPartitions("page_id")
    lines.select("value").write.text(path)
    return crawl.shards(spark, path, "CC-MAIN-2024-46", max_shards=15, base="https://shards.example")


@query
def cdx_captures(spark, sf):
    return crawl.cdx_captures(A.capture_lines(spark, sf), order="ord")


@query
def cdx_unfiltered(spark, sf):
    return crawl.cdx_captures(A.capture_lines(spark, sf), status=None, mime=None, order="ord")


@query
def cdx_limited(spark, sf):
    return crawl.cdx_captures(A.capture_lines(spark, sf), limit=20, order="ord", service_limits=True)


@query
def cdx_first(spark, sf):
    return crawl.cdx_captures(A.capture_lines(spark, sf), limit=150, order="ord")


@query
def cdx_dropped(spark, sf):
    return crawl.dropped_captures(A.capture_lines(spark, sf))


@query
def record_locations(spark, sf):
    return A.index_rows(spark, sf).select("url", crawl.record_url(F.col("warc_filename")).alias("record_url"))


@query
def archive_records(spark, sf):
    root = scratch_path(spark, "archive")
    records, _ = archive.archive_records(materialize(A.archive_pointers(spark, sf, root), "pointers"), root)
    return records.select(
        "page_id", "url", "target_uri", "status", F.md5("text").alias("text_md5"), F.length("text").alias("chars"), "charset_fallback"
    )


@query
def archive_rejects(spark, sf):
    root = scratch_path(spark, "archive")
    _, rejects = archive.archive_records(materialize(A.archive_pointers(spark, sf, root), "pointers"), root)
    return rejects.select("page_id", "error")


# Functions, routing, extraction


@query
def clean_website(spark, sf):
    return text.clean_website(A.raw_websites(spark, sf), "raw").select("page_id", "website")


@query
def lead_score(spark, sf):
    score = scoring.lead_score(F.col("rating"), F.col("reviews"), F.col("project_size"))
    return A.leads(spark, sf).select("s_suppkey", score.alias("score"))


@query
def route_host(spark, sf):
    return A.raw_websites(spark, sf).select("page_id", text.routing_host(F.col("raw")).alias("host"))


@query
def page_urls(spark, sf):
    pages = A.table(spark, sf, "pages")
    n = (F.col("page_id") % 5 - 1).cast("int")
    return pages.select("page_id", F.posexplode(text.page_urls(F.col("url"), n)).alias("pos", "page_url"))


@query
def extractor_pages(spark, sf):
    """Page URLs by the extractor's own form or its own code where it has one, else by the generic one."""
    routed = routing.route(A.table(spark, sf, "pages"), A.registry(spark))

    def by_path(base, n):
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.rtrim(base, F.lit("/")), F.lit("/p/"), i.cast("string")))

    def by_cursor(base, n):
        cursor = base  # each page names the next one
        for i in range(n):
            yield base if i == 0 else f"{base}#{cursor}"
            cursor = hashlib.md5(cursor.encode()).hexdigest()

    rows = routing.page_rows(routed, (F.col("page_id") % 4 + 1).cast("int"), {"com_site": by_path}, {"net_site": by_cursor})
    return rows.select("page_id", "pos", "page_url")


@query
def route_pages(spark, sf):
    routed = routing.route(A.table(spark, sf, "pages"), A.registry(spark))
    return routed.select("page_id", "url", "extractor_id")


def _records(spark, sf, tasks=None):
    routed = routing.route(A.table(spark, sf, "pages"), A.registry(spark))
    parsers = {n: extract.cards_parser(n) for n in ("blog_tionsh", "com_site", "net_site")}
    return extract.extract_records(routed, parsers, tasks=tasks)


@query
def extract_records(spark, sf, tasks=None):
    records, _ = _records(spark, sf, tasks)
    return records.select("page_id", "extractor_id", "ord", *extract.FIELDS)


@query
def extract_listing(spark, sf):
    records, _ = extract.extract_records(A.listing_pages(spark, sf), {"com_site": extract.cards_parser("com_site")})
    return records.select("page_id", "ord", "company_name", "summary", "source_directory", "source_url")


@query
def extract_titles(spark, sf):
    records, _ = _records(spark, sf)
    return records.select("page_id", "extractor_id", "company_name", "source_directory", "source_url")


@query
def valid_records(spark, sf):
    """Records of each conversation: a row without text is an empty record."""
    rows = A.table(spark, sf, "conversations").select(
        "conv_id", F.when(F.col("role") == "system", 0).when(F.length("text") > 0, 2).alias("record_size")
    )
    return extract.valid_records(rows, ["conv_id"])


@query
def source_urls(spark, sf):
    rows = A.table(spark, sf, "pages").select(
        "page_id", "url",
        F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "").alias("source_url"),
    )
    return extract.ensure_source_url(rows, F.col("url")).select("page_id", "source_url")


@query
def strip_html(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("text_md5"))


@query
def escape_html(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("html_md5"))


# Merges


@query
def upsert_items(spark, sf):
    root = scratch_path(spark, "items")
    store.create(A.items_current(spark, sf), root, ["company_name"], 32, "id")
    store.upsert(spark, root, A.items_batch(spark, sf), "pos", ["summary", "source_url"], {"created_at": A.as_of()})
    return store.read(spark, root)


@query
def insert_ignore(spark, sf):
    batch = A.items_batch(spark, sf).withColumns({"id": F.col("pos") + 1_000_000, "created_at": A.as_of()})
    return merge.insert_ignore(A.items_current(spark, sf), batch, ["company_name"], "pos")


@query
def dedupe_last(spark, sf):
    return merge.dedupe_last(A.items_batch(spark, sf), ["company_name"], "pos")


@query
def dedupe_first(spark, sf):
    return merge.dedupe_first(A.items_batch(spark, sf), ["company_name"], "pos")


@query
def items_recent(spark, sf):
    return feeds.read_items(A.items_current(spark, sf))


@query
def load_counts(spark, sf):
    """Distinct keys scraped and stored after a versioned write, the numbers of the load gate."""
    root = scratch_path(spark, "items")
    current = A.items_current(spark, sf)
    merge.write_version(current, root, 1)
    batch = A.items_batch(spark, sf)
    merge.write_version(
        merge.upsert(merge.read_version(spark, root), batch, ["company_name"], "pos", ["summary", "source_url"]), root, 2
    )
    keys = batch.select("company_name").distinct()
    stored = merge.read_version(spark, root).select("company_name", F.lit(True).alias("kept"))
    return keys.join(stored, "company_name", "left").agg(
        F.count("*").alias("scraped"), F.count("kept").alias("stored")
    )


@query
def run_registry(spark, sf):
    """Training-run registry keyed by run id: later rows replace a run's metrics."""
    e = A.table(spark, sf, "events")
    rows = e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("model_name"),
        F.create_map(F.lit("value"), F.col("value")).alias("metrics"),
        F.concat(F.lit("s3://runs/"), F.col("event_id").cast("string")).alias("artifact_uri"),
        F.col("event_id").alias("pos"),
    )
    current = merge.dedupe_first(rows, ["run_id"], "pos").drop("pos")
    out = merge.upsert(current, rows, ["run_id"], "pos")
    return out.select("run_id", "model_name", F.col("metrics")["value"].alias("metric"), "artifact_uri")


# Vectors, clusters, media


@query
def knn_cosine(spark, sf):
    return _knn(spark, sf, "Cosine")


@query
def knn_euclid(spark, sf):
    return _knn(spark, sf, "Euclid")


@query
def knn_pruned(spark, sf):
    """The cosine search over balls of points: those that cannot hold a hit are not scored."""
    points = A.points(spark, sf)
    index = ballsearch.build(points, scratch_path(spark, "ball-index"), "Cosine", 64)
    found = ballsearch.search(spark, index, A.centroids(spark, sf), 10)
    labels = points.select("id", F.col("label").cast("string").alias("label"))
    return found.join(labels, "id").select("query_id", "id", F.round("score", 6).alias("score"), "rank", "label")


@query
def knn_dot_threshold(spark, sf):
    return _knn(spark, sf, "Dot", 0.04)


def _knn(spark, sf, metric, threshold=None):
    points = A.points(spark, sf).withColumn("payload", F.create_map(F.lit("label"), F.col("label").cast("string")))
    found = vectors.search(points, A.centroids(spark, sf), 10, metric, threshold, payload="payload")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank", F.col("payload")["label"].alias("label"))


@query
def point_upsert(spark, sf):
    """Points replaced by a batch of the centroids of all labels, ids after and inside the table."""
    current = A.points(spark, sf).select(
        "id", "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload")
    )
    batch = A.centroids(spark, sf).select(
        (F.col("query_id") * 100).cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")
    )
    root = scratch_path(spark, "points")
    vectors.create_collection(spark, root, 64)
    vectors.upsert_points(spark, root, current)
    vectors.upsert_points(spark, root, batch)
    return vectors.read_points(spark, root).select("id", F.coalesce(F.col("payload")["label"], F.lit("")).alias("label"), F.posexplode("vector").alias("dim", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 5)
    )


@query
def collection_versions(spark, sf):
    """A collection made, filled with all points, then updated by the centroids of all labels."""
    root = scratch_path(spark, "collection")
    vectors.create_collection(spark, root, 64, "Dot")
    points = A.points(spark, sf).select("id", "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"))
    vectors.upsert_points(spark, root, points)
    batch = A.centroids(spark, sf).select((F.col("query_id") * 100).cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    vectors.upsert_points(spark, root, batch)
    dim, metric = vectors.collection_meta(spark, root)
    stored = vectors.read_points(spark, root)
    return stored.groupBy(F.coalesce(F.col("payload")["label"], F.lit("")).alias("label")).agg(
        F.count("*").alias("points"), F.max(F.size("vector")).alias("dims")
    ).withColumns({"dim": F.lit(dim), "metric": F.lit(metric)})


@query
def embed_hash(spark, sf, tasks=None):
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    rows = vectors.embed(docs, "text", functools.partial(vectors.HashingEncoder, 64), tasks=tasks)
    return rows.select("doc_id", F.posexplode("vector").alias("dim", "weight")).filter("weight > 0").withColumn(
        "weight", F.round(F.col("weight").cast("double"), 4)
    )


@query
def density_clusters(spark, sf):
    return cluster.density(A.points(spark, sf))


@query
def cluster_summary(spark, sf):
    return media.summarize(A.media(spark, sf))


@query
def cluster_brands(spark, sf):
    return media.cluster_brands(A.media(spark, sf))


@query
def media_context(spark, sf):
    m = A.media(spark, sf)
    return media.context(m, "cluster_id", "ord", "ocr_text", F.concat(F.lit("Brand "), F.col("cluster_id").cast("string")), F.lit("hello"))


@query
def frame_sample(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") - 20).alias("frames"))
    return media.sample_frames(docs, "frames", 5)


# Snapshots, payloads, reports


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


@query
def snapshot_manifest(spark, sf):
    tables = {n: A.table(spark, sf, n) for n in TABLES}
    manifest = snapshot.write(tables, scratch_path(spark, "snapshot"))
    return manifest.select("component", "row_count", "status")


@query
def restore_status(spark, sf):
    root = scratch_path(spark, "snapshot")
    snapshot.write({n: A.table(spark, sf, n) for n in TABLES}, root)
    restored = snapshot.restore(spark, root, [*TABLES, "absent"], scratch_path(spark, "restored"))
    return snapshot.restore_status(restored)


@query
def snapshot_rollup(spark, sf):
    tables = {n: A.table(spark, sf, n) for n in TABLES} | {"none": A.table(spark, sf, "region").where("r_regionkey < 0")}
    return snapshot.snapshot_status(snapshot.write(tables, scratch_path(spark, "snapshot")))


@query
def json_payloads(spark, sf):
    path = scratch_path(spark, "payloads")
    feeds.write_payloads(A.table(spark, sf, "pages").select("page_id", "url", "html"), path)
    back = feeds.read_payloads(spark, path, "page_id long, url string, html string")
    return back.select("page_id", "url", F.md5("html").alias("html_md5"))


@query
def report_cards(spark, sf):
    return report.cards(A.items_current(spark, sf)).select("company_name", "card")


@query
def report_page(spark, sf):
    return report.page(A.items_current(spark, sf))


# Streams


@query
def stream_log_errors(spark, sf):
    root = scratch_path(spark, "stream-logs")
    A.log_lines(spark, sf).select("value").repartition(8).write.text(f"{root}/segments")
    lines = stream_logs.read_segments(spark, f"{root}/segments", 3)
    q = stream_logs.write_errors(stream_logs.new_errors(lines), f"{root}/out", f"{root}/checkpoint", once=True)
    q.awaitTermination()
    return spark.read.schema("bundle_name string, message string").parquet(f"{root}/out").select("bundle_name", "message")


@query
def stream_log_tail(spark, sf):
    """Log files of 500 lines: first their beginnings, then all of it, then some cut down to 330 lines."""
    root = scratch_path(spark, "log-tail")
    lines = A.log_files(spark, sf)

    def scan(kept):
        A.write_logs(kept, f"{root}/logs")
        logtail.write_scans(logtail.tail(spark, f"{root}/logs"), f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()

    scan(lines.where("line <= 360"))
    scan(lines)
    scan(lines.where("file % 3 = 1 and line <= 330"))
    return logtail.read_scans(spark, f"{root}/out").select("scan", "bundle_name", "message")


@query
def stream_health(spark, sf):
    root = scratch_path(spark, "stream-health")
    A.runs(spark, sf).repartitionByRange(4, "created_at").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(A.runs(spark, sf).schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    q = stream_health_job(spark, sf, stream, root)
    q.awaitTermination()
    done = stream_jobs.current_health(spark, f"{root}/state")
    return done.select("bundle_name", "status", "total_runs_24h", "success_runs_24h", "failed_runs_24h")


@query
def stream_trailing(spark, sf):
    """The trailing day at the end of each five-minute bucket with runs, summed up by the stream itself."""
    root = scratch_path(spark, "stream-trailing")
    runs = A.runs(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    last = runs.agg(F.max("created_at")).select(F.lit(-1).cast("long").alias("id"), F.lit("clock").alias("bundle_name"), (F.col("max(created_at)") + F.expr("INTERVAL 3 DAYS")).alias("created_at"))
    runs.select("id", "bundle_name", "status", "created_at").write.parquet(f"{root}/in")
    # A later row closes the last windows.
    last.withColumn("status", F.lit("SUCCESS")).select("id", "bundle_name", "status", "created_at").write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("id long, bundle_name string, status string, created_at timestamp").parquet(f"{root}/in")
    stream_jobs.write_trailing(stream_jobs.trailing_stream(stream), f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    done = spark.read.parquet(f"{root}/out").where("bundle_name <> 'clock'")
    return done.withColumn("as_of", F.unix_seconds("as_of"))


def stream_health_job(spark, sf, stream, root):
    return stream_jobs.evaluate_health(
        stream, f"{root}/state", f"{root}/checkpoint", A.bundles(spark, sf), A.settings(spark, sf), A.as_of(), once=True
    )


@query
def stream_telemetry(spark, sf):
    root = scratch_path(spark, "stream-telemetry")
    A.runs(spark, sf).repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(A.runs(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream_jobs.append_telemetry(stream, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy(F.col("dt").cast("string").alias("dt"), "bundle_name").agg(
        F.count("*").alias("runs"), F.sum("items_scraped").alias("items")
    )
