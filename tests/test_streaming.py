"""Streams give what a batch gives, once."""

import datetime as dt

from pyspark.sql import functions as F

from sitemill.plans import health
from sitemill.streaming import health as jobs
from sitemill.streaming import logs


def scan(spark, root):
    lines = logs.read_segments(spark, f"{root}/in")
    q = logs.write_errors(logs.new_errors(lines), f"{root}/out", f"{root}/checkpoint", once=True)
    q.awaitTermination()
    rows = spark.read.schema("bundle_name string, message string").parquet(f"{root}/out").collect()
    return sorted((r["bundle_name"], r["message"]) for r in rows)


def test_new_segments_report_new_errors_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    first, second = "[ERROR] boom in bundle demo", "[ERROR] second boom in bundle demo"
    (tmp_path / "in" / "0.log").write_text(f"normal line\n{first}\n{first}\n")
    assert scan(spark, tmp_path) == [("unknown_bundle", first)]
    assert scan(spark, tmp_path) == [("unknown_bundle", first)]
    (tmp_path / "in" / "1.log").write_text(f"{second}\n{first}\nKeyError in bundles/shop/x.py\n")
    peeked = {tuple(r) for r in logs.peek(spark, f"{tmp_path}/in").collect()}
    assert scan(spark, tmp_path) == sorted(peeked) and len(peeked) == 3


NOW = dt.datetime(2024, 1, 31)
RUN = "id long, bundle_name string, status string, items_scraped int, created_at timestamp_ntz"


def test_health_follows_batches_and_repeats_safely(spark, tmp_path):
    root = str(tmp_path)
    bundles = spark.createDataFrame([("a",), ("b",), ("idle",)], "bundle_name string")
    conf = spark.createDataFrame([], "bundle_name string, sla_hours int, anomaly_ratio double")
    as_of = F.lit(NOW).cast("timestamp_ntz")

    def add(n, *rows):
        spark.createDataFrame([(i, b, s, 1, NOW - dt.timedelta(hours=h)) for i, (b, s, h) in enumerate(rows)], RUN).coalesce(1).write.parquet(
            f"{root}/in/seg={n}"
        )

    def step():
        stream = spark.readStream.schema(RUN).parquet(f"{root}/in/*")
        jobs.evaluate_health(stream, f"{root}/state", f"{root}/checkpoint", bundles, conf, as_of, once=True).awaitTermination()
        return {r["bundle_name"]: r["status"] for r in jobs.current_health(spark, f"{root}/state").collect()}

    add(0, ("a", "SUCCESS", 1), ("b", "SUCCESS", 20))
    assert step() == {"a": "HEALTHY", "b": "CRITICAL", "idle": "UNKNOWN"}
    add(1, ("b", "SUCCESS", 2))
    assert step() == {"a": "HEALTHY", "b": "HEALTHY", "idle": "UNKNOWN"}
    # An old success from an earlier batch still counts for a bundle touched now.
    add(2, ("a", "FAILED", 1), ("a", "FAILED", 1))
    assert step() == {"a": "CRITICAL", "b": "HEALTHY", "idle": "UNKNOWN"}
    wanted = spark.read.parquet(f"{root}/state/requests/at=*").select("bundle_name", "run_key").collect()
    assert sorted(r["run_key"] for r in wanted) == ["auto_repair_a_run-0000000002", "auto_repair_b_run-0000000000"]

    # No new rows: the clock alone finds that b stopped.
    for hours, idle, status in ((9, False, "HEALTHY"), (11, False, "CRITICAL"), (23, False, "UNKNOWN"), (24, True, "CRITICAL")):
        now = F.lit(NOW + dt.timedelta(hours=hours)).cast("timestamp_ntz")
        jobs.evaluate(spark, f"{root}/state", f"tick-{hours:010d}", bundles, conf, now, include_idle=idle)
        assert {r["bundle_name"]: r["status"] for r in jobs.current_health(spark, f"{root}/state").collect()}["b"] == status

    runs = spark.read.schema(RUN).parquet(f"{root}/in/*")
    batch = health.status(health.rollup(runs, as_of), as_of, bundles, conf)
    assert {r["bundle_name"]: r["status"] for r in batch.collect()} == {"a": "CRITICAL", "b": "HEALTHY", "idle": "UNKNOWN"}


def test_trailing_rollup(spark, tmp_path):
    root = str(tmp_path)
    rows = [(1, "a", "SUCCESS", 1, NOW), (2, "a", "FAILED", 1, NOW + dt.timedelta(hours=1)), (3, "z", "SUCCESS", 1, NOW + dt.timedelta(days=3))]
    df = spark.createDataFrame(rows, RUN).withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{root}/in")
    out = jobs.bucket_rollup(spark.readStream.schema(df.schema).parquet(f"{root}/in"))
    q = out.writeStream.outputMode("append").option("checkpointLocation", f"{root}/c").option("path", f"{root}/out").format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = jobs.trailing_rollup(spark.read.parquet(f"{root}/out")).collect()
    got = {(r["bundle_name"], str(r["as_of"])): (r["total_runs_24h"], r["failed_runs_24h"]) for r in rows}
    assert got == {("a", "2024-01-31 00:05:00"): (1, 0), ("a", "2024-01-31 01:05:00"): (2, 1)}


def test_telemetry_stream_appends_each_run_once(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(i, "a", "SUCCESS", i, NOW) for i in range(20)], RUN)
    df.repartition(4).write.parquet(f"{root}/in")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        jobs.append_telemetry(stream, f"{root}/out", f"{root}/c", once=True).awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 20 and out.first()["dt"] == dt.date(2024, 1, 31)


def test_trailing_windows_take_runs_up_to_an_hour_late(spark, tmp_path):
    root, schema = str(tmp_path), "bundle_name string, status string, created_at timestamp"
    at = lambda minutes: NOW + dt.timedelta(minutes=minutes)
    batches = [
        [("a", "SUCCESS", at(0)), ("a", "FAILED", at(2)), ("b", "DEGRADED", at(7))],
        [("a", "SUCCESS", at(90))],  # the watermark goes to 30 minutes
        [("a", "FAILED", at(45)), ("b", "SUCCESS", at(89)), ("a", "SUCCESS", at(1))],  # the last one is too late
        [("a", "SUCCESS", at(24 * 60 + 1))],
        [("clock", "SUCCESS", at(4 * 24 * 60))],
    ]
    kept, dropped = [], 0
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/n={n}")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        q = jobs.write_trailing(jobs.trailing_stream(stream), f"{root}/out", f"{root}/checkpoint", once=True)
        q.awaitTermination()
        dropped += jobs.late_groups(q)
        kept += [r for r in rows if r != ("a", "SUCCESS", at(1))]
    assert dropped == 1
    buckets = jobs.bucket_rollup(spark.createDataFrame(kept, schema))
    names = ["bundle_name", "as_of", "total_runs_24h", "success_runs_24h", "anomaly_runs_24h", "failed_runs_24h"]
    want = sorted(tuple(r) for r in jobs.trailing_rollup(buckets).where("bundle_name <> 'clock'").select(*names).collect())
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").where("bundle_name <> 'clock'").select(*names).collect())
    assert got == want and len(want) == 6
