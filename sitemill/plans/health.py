"""Pipeline health from the run log: rollup, status, digests, diagnostics, log errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill import constants as K
from sitemill.functions.text import blank_to_null, is_log_error, log_bundle, short, strip
from sitemill.operators.ranking import latest_per_key
from sitemill.session import materialize


def rollup(runs: DataFrame, as_of: Column, include_idle: bool = False) -> DataFrame:
    """Per bundle: the last 24 hours counted by outcome, and the last success of all time.

    Both sides come from one scan and one hash aggregate. Bundles without a run in
    the window have no row unless ``include_idle`` is set.
    """
    status, ts = F.col("status"), F.col("created_at")
    recent = ts >= as_of - F.expr("INTERVAL 24 HOURS")
    out = runs.groupBy("bundle_name").agg(
        F.count_if(recent).alias("total_runs_24h"),
        F.count_if(recent & (status == "SUCCESS")).alias("success_runs_24h"),
        F.count_if(recent & status.isin("ZERO_ROWS", "DEGRADED")).alias("anomaly_runs_24h"),
        F.count_if(recent & (status == "FAILED")).alias("failed_runs_24h"),
        F.sum(F.when(recent, F.col("items_scraped").cast("long"))).alias("total_items_scraped_24h"),
        F.max(F.when(recent, ts)).alias("last_run_timestamp"),
        F.max(F.when(status == "SUCCESS", ts)).alias("last_success_timestamp"),
    )
    return out if include_idle else out.filter("total_runs_24h > 0")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (_micros(end) - _micros(start)) / F.lit(3.6e9)


def one_decimal(number: Column) -> Column:
    """Text with one decimal, rounded from the binary value as printf does, not from its decimal text."""
    return F.replace(F.format_number(number, 1), F.lit(","), F.lit(""))


def status(
    view: DataFrame,
    as_of: Column,
    bundles: DataFrame,
    settings: DataFrame,
    log_errors: DataFrame | None = None,
) -> DataFrame:
    """Health per bundle, known or seen, with its issues in rule order.

    ``view`` has the columns of :func:`rollup`; ``settings`` has ``bundle_name,
    sla_hours, anomaly_ratio`` (null = default); ``log_errors`` comes from
    :func:`log_error_summary`.
    """
    df = bundles.select("bundle_name").distinct().join(view, "bundle_name", "full_outer")
    df = df.join(settings.select("bundle_name", "sla_hours", "anomaly_ratio"), "bundle_name", "left")
    if log_errors is None:
        df = df.withColumns(
            {"first_error": F.lit(None).cast("string"), "stdout_error_count": F.lit(0)}
        )
    else:
        df = df.join(
            log_errors.select("bundle_name", "first_error", "stdout_error_count"),
            "bundle_name",
            "left",
        )

    counts = [
        "total_runs_24h",
        "success_runs_24h",
        "anomaly_runs_24h",
        "failed_runs_24h",
        "total_items_scraped_24h",
        "stdout_error_count",
    ]
    df = df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts}
        | {
            "sla_hours": F.coalesce("sla_hours", F.lit(K.STALENESS_SLA_HOURS)),
            "anomaly_ratio": F.coalesce("anomaly_ratio", F.lit(K.ANOMALY_RATIO)),
            "hours_since_success": hours_between(F.col("last_success_timestamp"), as_of),
        }
    )

    total, last_ok = F.col("total_runs_24h"), F.col("last_success_timestamp")
    percent = (F.col("anomaly_ratio") * 100).cast("int")

    def share_reached(count: str) -> Column:
        return (F.col(count) > 0) & (
            F.col(count) / F.greatest(total, F.lit(1)) >= F.col("anomaly_ratio")
        )

    no_data = (total == 0) & last_ok.isNull()
    logged = F.col("stdout_error_count") > 0
    anomalous = share_reached("anomaly_runs_24h")
    failing = share_reached("failed_runs_24h")
    stale = F.coalesce(F.col("hours_since_success") > F.col("sla_hours"), F.lit(False))
    never = last_ok.isNull() & (total > 0)

    def issue(when: Column, alert: str | None, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(alert).cast("string").alias("alert_type"), text.alias("message")))

    found = F.array(
        issue(no_data, None, F.lit(K.ISSUE_NO_DATA)),
        issue(logged, K.ALERT_STDOUT, F.format_string(K.ISSUE_STDOUT, F.col("first_error"))),
        issue(
            anomalous,
            K.ALERT_ANOMALY,
            F.format_string(K.ISSUE_ANOMALY, F.col("anomaly_runs_24h"), total, percent),
        ),
        issue(
            failing,
            K.ALERT_FAILURE,
            F.format_string(K.ISSUE_FAILURE, F.col("failed_runs_24h"), total, percent),
        ),
        issue(
            stale,
            K.ALERT_STALE,
            F.format_string(
                K.ISSUE_STALE, one_decimal(F.col("hours_since_success")), F.col("sla_hours").cast("int")
            ),
        ),
        issue(never, K.ALERT_NEVER, F.format_string(K.ISSUE_NEVER, F.col("bundle_name"), total)),
    )
    return df.withColumns(
        {
            "status": F.when(failing | stale | never, "CRITICAL")
            .when(anomalous | logged, "DEGRADED")
            .when(no_data, "UNKNOWN")
            .otherwise("HEALTHY"),
            "issues": F.filter(found, lambda i: i.isNotNull()),
            "last_success": F.coalesce(last_ok.cast("string"), F.lit("Never")),
        }
    )


def action(status: Column, issue_count: Column) -> Column:
    return (
        F.when(status == "CRITICAL", "REMEDIATE")
        .when((status == "HEALTHY") & (issue_count == 0), "OK")
        .otherwise("WATCH")
    )


def issues(health: DataFrame) -> DataFrame:
    """One row per issue, numbered in rule order."""
    return health.select(
        "bundle_name", "status", F.posexplode("issues").alias("pos", "issue")
    ).select(
        "bundle_name",
        "status",
        (F.col("pos") + 1).alias("issue_no"),
        F.col("issue.alert_type").alias("alert_type"),
        F.col("issue.message").alias("message"),
    )


def last_runs(runs: DataFrame) -> DataFrame:
    """Latest log row per bundle, error text cut to the message width."""
    newest = latest_per_key(runs, "bundle_name", "created_at", "id")
    return newest.withColumn("error_message", short(F.col("error_message")))


FAILURES = ("ZERO_ROWS", "FAILED", "DEGRADED")


def last_failures(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs.filter(F.col("status").isin(*FAILURES)), "bundle_name", "created_at", "id")


def digest(
    health: DataFrame,
    runs: DataFrame,
    requested: DataFrame | None = None,
    next_command: str = "diagnose",
) -> DataFrame:
    """Compact row per bundle: action, counters, first two issues, last log row.

    ``requested`` (``bundle_name, bundle_exists``) asks for named bundles; one without
    a health row gets action WATCH when it exists and STOP when it does not.
    """
    last = last_runs(runs).select(
        "bundle_name",
        F.struct(
            "status", "items_scraped", "http_403_count", "http_429_count", "error_message", "created_at"
        ).alias("last_log"),
    )
    rows = health.select(
        "bundle_name",
        "status",
        action(F.col("status"), F.size("issues")).alias("action"),
        F.col("total_runs_24h").alias("runs_24h"),
        F.col("success_runs_24h").alias("success_24h"),
        F.col("total_items_scraped_24h").alias("items_24h"),
        "last_success",
        "sla_hours",
        F.transform(F.slice("issues", 1, 2), lambda i: short(i["message"])).alias("issues"),
    ).join(last, "bundle_name", "left")
    if requested is not None:
        rows = requested.join(rows, "bundle_name", "left").withColumn(
            "action",
            F.coalesce("action", F.when(F.col("bundle_exists"), "WATCH").otherwise("STOP")),
        )
        rows = rows.withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))
    return rows.withColumn(
        "next",
        F.when(
            F.col("action") == "REMEDIATE",
            F.concat(F.lit(f"{next_command} "), F.col("bundle_name")),
        ),
    )


def report(health: DataFrame) -> DataFrame:
    """Health rows in order of bundle name, as a report shows them."""
    return health.orderBy("bundle_name")


def fleet(health: DataFrame) -> DataFrame:
    """Fleet digest, one short row per bundle."""
    return health.select(
        F.col("bundle_name").alias("name"),
        "status",
        action(F.col("status"), F.size("issues")).alias("action"),
        F.col("total_items_scraped_24h").alias("items_24h"),
        F.col("total_runs_24h").alias("runs_24h"),
        F.size("issues").alias("issues_n"),
    )


def fleet_action(fleet_rows: DataFrame) -> DataFrame:
    """The worst action over the fleet and the number of bundles."""
    severity = (
        F.when(F.col("action") == "REMEDIATE", 2).when(F.col("action") == "WATCH", 1).otherwise(0)
    )
    worst = F.max(severity)
    return fleet_rows.agg(
        F.when(worst == 2, "REMEDIATE").when(worst == 1, "WATCH").otherwise("OK").alias("action"),
        F.count("*").alias("count"),
    )


def diagnostics(runs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Diagnostic row per bundle from its last run and its last failure.

    Both come from the same two scans: the newest times per bundle, then the rows at them.
    """
    failed, ts = F.col("status").isin(*FAILURES), F.col("created_at")
    newest = runs.groupBy("bundle_name").agg(
        F.max(ts).alias("_last"), F.max(F.when(failed, ts)).alias("_failed")
    )
    newest = materialize(newest, "newest")
    row = F.struct(
        "created_at", "id", "status", "error_message", "items_scraped",
        "http_200_count", "http_403_count", "http_429_count", "http_500_count",
    )
    is_last, is_failure = ts == F.col("_last"), failed & (ts == F.col("_failed"))
    few = runs.join(newest, "bundle_name").filter(is_last | is_failure)
    found = few.groupBy("bundle_name").agg(
        F.max(F.when(is_last, row)).alias("last"), F.max(F.when(is_failure, row)).alias("failure")
    )
    df = bundles.select("bundle_name").distinct().join(found, "bundle_name", "full_outer")
    return df.select(
        "bundle_name",
        F.coalesce(blank_to_null(F.col("last.status")), "failure.status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce(blank_to_null(F.col("failure.error_message")), "last.error_message").alias("error_message"),
        "last.items_scraped",
        "last.http_200_count",
        "last.http_403_count",
        "last.http_429_count",
        "last.http_500_count",
        "last.created_at",
    )


def failure_mode(status: Column, http_403: Column, http_429: Column, error: Column) -> Column:
    """A: no rows (selector drift); B: access refused or limited; C: exception."""
    return (
        F.when(status == "ZERO_ROWS", "A")
        .when(F.coalesce(http_403, F.lit(0)) + F.coalesce(http_429, F.lit(0)) > 0, "B")
        .when(blank_to_null(error).isNotNull(), "C")
    )


def probe_health(probes: DataFrame, keys: list[str]) -> DataFrame:
    """HEALTHY when every probe of a group answered 200."""
    ok = F.count_if(F.col("status_code") == 200)
    return probes.groupBy(*keys).agg(
        F.when(ok == F.count("*"), "HEALTHY").otherwise("DEGRADED").alias("status"),
        F.concat(ok.cast("string"), F.lit("/"), F.count("*").cast("string")).alias(
            "successful_requests"
        ),
    )


def stuck_runs(run_states: DataFrame, as_of: Column) -> DataFrame:
    """Runs that have been starting, started or queued for more than half an hour."""
    limit = F.expr(f"INTERVAL {K.STUCK_RUN_SECONDS} SECONDS")
    return run_states.filter(
        F.col("status").isin("STARTED", "STARTING", "QUEUED") & (F.col("updated_at") < as_of - limit)
    )


def log_error_rows(lines: DataFrame) -> DataFrame:
    """Error lines with their bundle; ``lines`` has ``value`` and an order column ``ord``."""
    return lines.filter(is_log_error(F.col("value"))).select(
        log_bundle(F.col("value")).alias("bundle_name"),
        short(strip(F.col("value"))).alias("message"),
        "ord",
    )


def log_errors(lines: DataFrame) -> DataFrame:
    """Distinct error messages per bundle with the place each was first seen."""
    return log_error_rows(lines).groupBy("bundle_name", "message").agg(F.min("ord").alias("ord"))


def log_error_summary(errors: DataFrame) -> DataFrame:
    """First error and error count per bundle, the input of :func:`status`.

    The messages themselves stay rows of :func:`log_errors`: a bundle may have any number.
    """
    return errors.groupBy("bundle_name").agg(
        F.min(F.struct("ord", "message"))["message"].alias("first_error"),
        F.count("*").alias("stdout_error_count"),
    )
