"""Health rules, log scan, digests and alerts on hand-built rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitemill.operators.ranking import latest_per_key
from sitemill.plans import alerts, health

NOW = dt.datetime(2024, 1, 31)
VIEW = (
    "bundle_name string, total_runs_24h long, success_runs_24h long, anomaly_runs_24h long, failed_runs_24h long, "
    "total_items_scraped_24h long, last_run_timestamp timestamp_ntz, last_success_timestamp timestamp_ntz"
)


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")


def row(name, total=0, ok=0, anomaly=0, failed=0, items=0, success_hours=None):
    last = None if success_hours is None else NOW - dt.timedelta(hours=success_hours)
    return (name, total, ok, anomaly, failed, items, None, last)


def status(spark, rows, names=None, errors=None, settings=()):
    view = spark.createDataFrame(rows, VIEW)
    bundles = spark.createDataFrame([(n,) for n in names or [r[0] for r in rows]], "bundle_name string")
    conf = spark.createDataFrame(list(settings), "bundle_name string, sla_hours int, anomaly_ratio double")
    out = health.status(view, as_of(), bundles, conf, errors)
    return {r["bundle_name"]: r for r in out.collect()}


def texts(r):
    return [i["message"] for i in r["issues"]]


def test_cases(spark):
    got = status(
        spark,
        [
            row("failed", 10, failed=10),
            row("never", 2, anomaly=1),
            row("stale", success_hours=48),
            row("healthy", 5, 5, items=50, success_hours=1),
        ],
        ["failed", "never", "stale", "healthy", "nothing"],
    )
    assert got["failed"]["status"] == "CRITICAL"
    assert got["never"]["status"] == "CRITICAL"
    assert any("never" in t.lower() or "No successful" in t for t in texts(got["never"]))
    assert got["nothing"]["status"] == "UNKNOWN" and got["nothing"]["last_success"] == "Never"
    assert got["stale"]["status"] == "CRITICAL"
    assert texts(got["stale"]) == ["Staleness SLA breached! Last successful run was 48.0 hours ago (SLA: 12h)."]
    assert got["healthy"]["status"] == "HEALTHY" and texts(got["healthy"]) == []


def test_thresholds_are_reached_at_equality(spark):
    got = status(
        spark,
        [row("a", 10, 7, 3, 0, success_hours=1), row("b", 10, 8, 2, 0, success_hours=1), row("c", 10, 7, 0, 3, success_hours=1)],
    )
    assert [got[k]["status"] for k in "abc"] == ["DEGRADED", "HEALTHY", "CRITICAL"]
    assert texts(got["a"]) == [
        "High anomaly rate (3/10 runs returned 0 items, threshold: 30%). Target HTML selector changed?"
    ]


def test_settings_override(spark):
    got = status(spark, [row("a", 10, 7, 3, 0, success_hours=8)], settings=[("a", 6, 0.5)])
    assert got["a"]["status"] == "CRITICAL" and len(got["a"]["issues"]) == 1


def test_idle_bundle_option(spark):
    runs = spark.createDataFrame(
        [(1, "idle", "SUCCESS", 3, NOW - dt.timedelta(days=3))],
        "id long, bundle_name string, status string, items_scraped int, created_at timestamp_ntz",
    )
    assert health.rollup(runs, as_of()).count() == 0
    (r,) = health.rollup(runs, as_of(), include_idle=True).collect()
    assert r["total_runs_24h"] == 0 and r["last_success_timestamp"] == NOW - dt.timedelta(days=3)


def test_log_errors(spark):
    lines = spark.createDataFrame(
        [
            (1, "normal line"),
            (2, "[ERROR] boom in bundle demo"),
            (3, "  keyerror in bundles/demo_1/x.py  "),
            (4, "[ERROR] boom in bundle demo"),
            (5, "[error] " + "x" * 200 + " bundle/late"),
        ],
        "ord long, value string",
    )
    got = {(r[0], r[1]): r[2] for r in health.log_errors(lines).collect()}
    assert got[("unknown_bundle", "[ERROR] boom in bundle demo")] == 2
    assert got[("demo_1", "keyerror in bundles/demo_1/x.py")] == 3
    assert len(got) == 3 and all(len(m) <= 140 for _, m in got)


def test_log_errors_degrade_only_named_bundles(spark):
    errors = spark.createDataFrame(
        [("a", "E1", 2), ("unknown_bundle", "E2", 1)], "bundle_name string, first_error string, stdout_error_count long"
    )
    got = status(spark, [row("a", 5, 5, success_hours=1), row("b", 5, 5, success_hours=1)], errors=errors)
    assert got["a"]["status"] == "DEGRADED" and got["b"]["status"] == "HEALTHY"
    assert texts(got["a"]) == ["Dagster process STDOUT error detected: 'E1'"]
    assert "unknown_bundle" not in got


def test_digest_of_unknown_bundles(spark):
    runs = spark.createDataFrame(
        [(1, "a", "FAILED", 0, 0, 0, "x" * 200, NOW)],
        "id long, bundle_name string, status string, items_scraped int, http_403_count int, http_429_count int, error_message string, created_at timestamp_ntz",
    )
    view = spark.createDataFrame([row("a", 1, failed=1)], VIEW)
    conf = spark.createDataFrame([], "bundle_name string, sla_hours int, anomaly_ratio double")
    h = health.status(view, as_of(), view.select("bundle_name"), conf)
    wanted = spark.createDataFrame([("a", True), ("gone", False), ("new", True)], "bundle_name string, bundle_exists boolean")
    got = {r["bundle_name"]: r for r in health.digest(h, runs, wanted).collect()}
    assert got["a"]["action"] == "REMEDIATE" and got["a"]["next"] == "diagnose a"
    assert len(got["a"]["issues"]) == 2 and len(got["a"]["last_log"]["error_message"]) == 140
    assert got["gone"]["action"] == "STOP" and got["new"]["action"] == "WATCH"
    assert got["gone"]["status"] == "UNKNOWN"


def test_latest_settles_ties_by_id(spark):
    runs = spark.createDataFrame(
        [(i, "a", "FAILED" if i % 2 else "SUCCESS", f"e{i}", NOW) for i in range(6)],
        "id long, bundle_name string, status string, error_message string, created_at timestamp_ntz",
    )
    assert [r["id"] for r in health.last_runs(runs).collect()] == [5]


def test_fan_out(spark):
    rows = spark.createDataFrame([("<b>x</b> &lt;y&gt;", "E", '{"a":1}')], "text_html string, event string, payload string")
    got = alerts.fan_out(rows, [("chat", "c"), ("chat_webhook", "w"), ("webhook", "g"), ("webhook", "g"), ("webhook", "")], F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"))
    assert {(r["channel"], r["body"]) for r in got.collect()} == {
        ("chat", "<b>x</b> &lt;y&gt;"),
        ("chat_webhook", "x <y>"),
        ("webhook", '{"event":"E","payload":{"a":1},"timestamp":"2024-01-31T10:00:00.000000+00:00"}'),
    }
    assert alerts.fan_out(rows, []).count() == 0


def test_one_decimal_rounds_the_binary_value(spark):
    rng = random.Random(1)
    numbers = [12.35, 12.45, 12.55, 0.25, 0.05, 1234.5678, 24.0] + [rng.randrange(10_000) / 20 for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", health.one_decimal(F.col("x")).alias("t")).collect()
    assert all(r["t"] == f"{r['x']:.1f}" for r in rows)


def test_newest_row_without_time_is_found(spark):
    runs = spark.createDataFrame([(1, "a", None), (2, "a", None)], "id long, bundle_name string, created_at timestamp_ntz")
    assert [r["id"] for r in latest_per_key(runs, "bundle_name", "created_at", "id").collect()] == [2]


def test_report_order(spark):
    rows = spark.createDataFrame([("c",), ("a",), ("b",)], "bundle_name string")
    assert [r[0] for r in health.report(rows).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(
    ("values", "mode"),
    [(("ZERO_ROWS", 5, 0, "x"), "A"), (("FAILED", 0, 2, "x"), "B"), (("FAILED", 0, 0, "x"), "C"), (("FAILED", 0, 0, ""), None)],
)
def test_failure_mode(spark, values, mode):
    df = spark.createDataFrame([values], "s string, a int, b int, e string")
    assert df.select(health.failure_mode(*[F.col(c) for c in "sabe"])).first()[0] == mode
