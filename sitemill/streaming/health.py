"""Run log as a stream: telemetry append, trailing-window rollup, periodic health evaluation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitemill.operators.ranking import one_per_key
from sitemill.plans import health
from sitemill.sources.feeds import TELEMETRY

BUCKET = "5 minutes"


def _start(writer, once: bool) -> StreamingQuery:
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime="300 seconds").start()


def append_telemetry(runs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Finished runs appended to the day-partitioned telemetry table."""
    rows = runs.select(*[c for c in TELEMETRY if c in runs.columns]).withColumn(
        "dt", F.to_date("created_at")
    )
    writer = rows.writeStream.format("parquet").partitionBy("dt").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return _start(writer, once)


def bucket_rollup(runs: DataFrame, bucket: str = BUCKET, late: str = "1 hour") -> DataFrame:
    """Counts per bundle and tumbling event-time bucket: each run is counted once."""
    status = F.col("status")
    return (
        runs.withWatermark("created_at", late)
        .groupBy(F.window("created_at", bucket).alias("w"), "bundle_name")
        .agg(
            F.count("*").alias("total_runs"),
            F.count_if(status == "SUCCESS").alias("success_runs"),
            F.count_if(status.isin("ZERO_ROWS", "DEGRADED")).alias("anomaly_runs"),
            F.count_if(status == "FAILED").alias("failed_runs"),
        )
        .select("bundle_name", F.col("w.end").alias("as_of"), "total_runs", "success_runs", "anomaly_runs", "failed_runs")
    )


KINDS = ("total", "success", "anomaly", "failed")


def trailing_stream(runs: DataFrame, bucket: str = BUCKET, late: str = "1 hour", hours: int = 24) -> DataFrame:
    """The rollup of the last ``hours`` at the end of every bucket that has runs, kept by the stream.

    Runs are counted in tumbling buckets first, buckets in windows that slide by one bucket, so
    the state is the open buckets and windows of each bundle, whatever the number of runs. A run that is up
    to ``late`` behind the newest counts; later ones are dropped and counted (``late_groups``).
    """
    status = F.col("status")
    counts = {"total": F.count(F.lit(1)), "success": F.count_if(status == "SUCCESS"), "anomaly": F.count_if(status.isin("ZERO_ROWS", "DEGRADED")), "failed": F.count_if(status == "FAILED")}
    small = runs.withWatermark("created_at", late).groupBy(F.window("created_at", bucket).alias("w"), "bundle_name").agg(*[c.alias(k) for k, c in counts.items()])
    at = F.window(F.window_time("w"), f"{hours} hours", bucket).alias("t")
    sums = small.groupBy(at, "bundle_name").agg(*[F.sum(k).alias(f"{k}_runs_{hours}h") for k in KINDS], F.max("w.end").alias("newest"))
    ends = sums.where(F.col("newest") == F.col("t.end"))
    return ends.select("bundle_name", F.col("t.end").alias("as_of"), *[f"{k}_runs_{hours}h" for k in KINDS])


def write_trailing(rollup: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The closed windows, each once.

    A bucket lies in as many windows as a window has buckets; one generated method for all of them
    would be too long to compile, so this query (it keeps the settings of its start) goes without.
    """
    writer = rollup.writeStream.outputMode("append").format("parquet").option("path", path)
    conf, name = rollup.sparkSession.conf, "spark.sql.codegen.wholeStage"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return _start(writer.option("checkpointLocation", checkpoint), once)
    finally:
        conf.set(name, before)


def late_groups(query: StreamingQuery) -> int:
    """Rows that came too late, as far as the query still remembers its batches; runs of one bundle and bucket in one task of a batch are one row."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def trailing_rollup(buckets: DataFrame, hours: int = 24) -> DataFrame:
    """The rollup of the last ``hours`` at the end of every bucket, from stored buckets (an extension)."""
    at = F.unix_seconds(F.col("as_of").cast("timestamp"))
    span = Window.partitionBy("bundle_name").orderBy(at).rangeBetween(-hours * 3600 + 1, 0)
    return buckets.select("bundle_name", "as_of", *[F.sum(f"{k}_runs").over(span).alias(f"{k}_runs_{hours}h") for k in KINDS])


def store_runs(batch: DataFrame, number: int, root: str) -> None:
    """A batch of runs added to the log below ``root``, and the newest success per bundle so far.

    The log is laid out by day, then batch, so a window is a few folders; a repeated batch
    replaces its own.
    """
    spark = batch.sparkSession
    rows = batch.withColumns({"dt": F.to_date("created_at"), "batch": F.lit(number)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(f"{root}/runs")
    seen = batch.filter("status = 'SUCCESS'").select("bundle_name", "created_at")
    if number > 0:
        seen = seen.unionByName(spark.read.schema(seen.schema).parquet(f"{root}/last_success/batch={number - 1:010d}"))
    newest = seen.groupBy("bundle_name").agg(F.max("created_at").alias("created_at"))
    newest.write.mode("overwrite").parquet(f"{root}/last_success/batch={number:010d}")


def evaluate(
    spark: SparkSession, root: str, label: str, bundles: DataFrame, settings: DataFrame, now: Column, include_idle: bool = False
) -> None:
    """Health of all bundles, known or seen, from the stored log; remediation requests for the bad ones.

    A bundle without a run in the window is UNKNOWN; with ``include_idle`` its last success counts
    and it can be stale. Reads the days of the window and the last successes. Writes to folders named by ``label``, so a
    repeated evaluation replaces its first attempt.
    """
    log = read_log(spark, root)
    recent = log.filter(F.col("dt") >= F.to_date(now - F.expr("INTERVAL 24 HOURS")))
    successes = spark.read.option("basePath", f"{root}/last_success").parquet(f"{root}/last_success")
    last = successes.agg(F.max("batch")).first()[0]
    newest = successes.filter(F.col("batch") == last).select("bundle_name", F.col("created_at").alias("last_success_timestamp"))
    view = health.rollup(recent, now).drop("last_success_timestamp").join(newest, "bundle_name", "full_outer" if include_idle else "left")
    rows = health.status(view, now, bundles, settings).drop("issues")
    rows = rows.withColumns({"evaluated_at": now, "evaluated_in": F.lit(label)})
    rows.write.mode("overwrite").parquet(f"{root}/health/at={label}")
    rows = spark.read.parquet(f"{root}/health/at={label}")
    wanted = rows.filter(F.col("status").isin("DEGRADED", "CRITICAL")).select(
        "bundle_name", "status", F.concat(F.lit("auto_repair_"), "bundle_name", F.lit(f"_{label}")).alias("run_key")
    )
    wanted.write.mode("overwrite").parquet(f"{root}/requests/at={label}")


def evaluate_health(
    runs: DataFrame,
    root: str,
    checkpoint: str,
    bundles: DataFrame,
    settings: DataFrame,
    as_of: Column | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Store every batch of runs and evaluate all bundles after it."""

    def step(batch: DataFrame, number: int) -> None:
        store_runs(batch, number, root)
        evaluate(batch.sparkSession, root, f"run-{number:010d}", bundles, settings, F.current_timestamp() if as_of is None else as_of)

    return _start(runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), once)


def watch_health(spark: SparkSession, root: str, checkpoint: str, bundles: DataFrame, settings: DataFrame) -> StreamingQuery:
    """Evaluate all bundles every five minutes by the clock, whether runs come in or not.

    A bundle that stopped sends no rows; only the clock can find it stale.
    """

    def tick(batch: DataFrame, number: int) -> None:
        evaluate(batch.sparkSession, root, f"tick-{number:010d}", bundles, settings, F.current_timestamp())

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return _start(clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint), once=False)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The run log written so far; day and batch come from the folder names."""
    return spark.read.option("basePath", f"{root}/runs").parquet(f"{root}/runs")


def current_health(spark: SparkSession, root: str) -> DataFrame:
    """The latest evaluation of every bundle."""
    rows = spark.read.option("basePath", f"{root}/health").parquet(f"{root}/health")
    return one_per_key(rows, ["bundle_name"], [F.col("evaluated_at").desc(), F.col("evaluated_in").desc()]).drop("at")
