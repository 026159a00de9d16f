"""Alert rows from health issues and their fan-out to channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.functions.text import strip_html

def _payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)


def _time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def degradation_alerts(issues: DataFrame, sent_at: Column, command: str = "sitemill") -> DataFrame:
    """One alert per issue that has an alert type.

    ``issues`` has ``bundle_name, alert_type, message`` and may carry ``http_403_count``
    and ``http_429_count``; absent counters are zero, as in the health audit.
    """
    have = set(issues.columns)
    zero = F.lit(0)
    n403 = F.coalesce(F.col("http_403_count"), zero) if "http_403_count" in have else zero
    n429 = F.coalesce(F.col("http_429_count"), zero) if "http_429_count" in have else zero
    bundle, kind, details = F.col("bundle_name"), F.col("alert_type"), F.col("message")
    text = F.format_string(
        "<b>%s</b>: <code>%s</code> at %s\n%s\nBlocked requests: %d with 403, %d with 429\n"
        f"Run <code>{command} health --auto-fix %s</code>",
        bundle, kind, _time(sent_at), details, n403, n429, bundle,
    )
    return issues.filter(kind.isNotNull()).select(
        bundle,
        kind,
        F.lit("SCRAPER_ALERT").alias("event"),
        text.alias("text_html"),
        _payload(
            bundle_name=bundle, alert_type=kind, details=details, http_403_count=n403, http_429_count=n429
        ).alias("payload"),
    )


def repair_alerts(repairs: DataFrame, sent_at: Column) -> DataFrame:
    """Alerts for ``bundle_name, model_used, attempt, modified_lines_count`` rows."""
    cols = [F.col(c) for c in ("bundle_name", "model_used", "attempt", "modified_lines_count")]
    text = F.format_string("<b>%s</b>: repaired by <code>%s</code> in attempt %d at %s\nChanged lines: %d", *cols[:3], _time(sent_at), cols[3])
    return repairs.select(
        "bundle_name",
        F.lit("AUTO_REPAIR_SUCCESS").alias("event"),
        text.alias("text_html"),
        _payload(**{c: F.col(c) for c in ("bundle_name", "model_used", "attempt", "modified_lines_count")}).alias("payload"),
    )


def attention_alerts(failures: DataFrame, sent_at: Column, command: str = "sitemill") -> DataFrame:
    """Alerts for ``bundle_name, retries_count, last_error`` rows whose retries ran out."""
    bundle, retries, error = F.col("bundle_name"), F.col("retries_count"), F.col("last_error")
    text = F.format_string(
        "<b>%s</b>: given up after %d repairs at %s\nLast error: <code>%s</code>\n"
        f"Run <code>{command} health --fix %s</code>",
        bundle, retries, _time(sent_at), error, bundle,
    )
    return failures.select(
        bundle,
        F.lit("HUMAN_ATTENTION").alias("event"),
        text.alias("text_html"),
        _payload(bundle_name=bundle, retries_count=retries, last_error=error).alias("payload"),
    )


def fan_out(alerts: DataFrame, channels: list[tuple[str, str]], sent_at: Column | None = None) -> DataFrame:
    """One row per alert and channel, each target once, in the order given.

    ``channels`` are ``(kind, target)`` with kind ``chat`` (HTML text), ``chat_webhook``
    (plain text) or ``webhook`` (JSON of event, payload and time). No channels give no rows.
    """
    now = F.current_timestamp() if sent_at is None else sent_at
    targets = list(dict.fromkeys((k, t) for k, t in channels if t))
    if not targets:
        return alerts.limit(0).select(
            "*", *[F.lit("").alias(c) for c in ("channel", "target", "body")]
        )
    entries = [
        F.struct(F.lit(kind).alias("channel"), F.lit(target).alias("target"))
        for kind, target in targets
    ]
    rows = alerts.select("*", F.inline(F.array(*entries)))
    body = (
        F.when(F.col("channel") == "chat", F.col("text_html"))
        .when(F.col("channel") == "chat_webhook", strip_html(F.col("text_html")))
        .otherwise(
            # The payload is JSON already; the other two are quoted here.
            F.format_string(
                '{"event":%s,"payload":%s,"timestamp":"%s"}', _quoted(F.col("event")), F.col("payload"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
            )
        )
    )
    sendable = F.when(F.col("channel") == "webhook", F.col("event").isNotNull()).otherwise(
        F.coalesce(F.col("text_html") != "", F.lit(False))
    )
    return rows.filter(sendable).withColumn("body", body)
