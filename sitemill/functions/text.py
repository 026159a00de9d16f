"""String and URL functions: ``Column -> Column``, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.constants import (
    LOG_BUNDLE_PATTERN,
    LOG_ERROR_PATTERNS,
    MESSAGE_CHARS,
    PAGES,
    UNKNOWN_BUNDLE,
    WHITESPACE,
)


def strip(c: Column) -> Column:
    """Unicode-aware strip; plain ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def short(c: Column) -> Column:
    """The first 140 characters, the width of messages in digests."""
    return F.left(c, F.lit(MESSAGE_CHARS))


def strip_html(c: Column) -> Column:
    """Drop tags, then decode the three entities the alert texts use."""
    bare = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def escape_html(c: Column) -> Column:
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def is_log_error(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(LOG_ERROR_PATTERNS))


def log_bundle(line: Column) -> Column:
    """The bundle a log line names by path, else ``unknown_bundle``."""
    named = blank_to_null(F.regexp_extract(line, LOG_BUNDLE_PATTERN, 1))
    return F.coalesce(named, F.lit(UNKNOWN_BUNDLE))


def routing_host(url: Column) -> Column:
    """Host used for extractor routing.

    Not ``parse_url``: a query that follows the host without a slash stays in.
    """
    host = F.lower(strip(url))
    for prefix in ("^https://", "^http://", r"^www\."):
        host = F.regexp_replace(host, prefix, "")
    return F.substring_index(F.substring_index(host, "/", 1), ":", 1)


def page_urls(base: Column, max_pages: Column) -> Column:
    """Array of the base URL and its ``page=1 .. n-1`` variants; ``n=10`` when not positive."""
    n = F.when(max_pages <= 0, F.lit(PAGES)).otherwise(max_pages)
    delim = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    # sequence(1, 0) would count down, hence the guard.
    numbered = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.concat(base, delim, F.lit("page="), i.cast("string")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), numbered)


def clean_website(df: DataFrame, raw: str, out: str = "website") -> DataFrame:
    """Adds ``out``: canonical ``https://host/path`` of the link ``raw``: unwrapped redirect, no query or fragment.

    Each step is a column of its own, so that none is repeated inside the next.
    """
    url, target, link, whole, netloc = (F.col(f"_web_{k}") for k in ("url", "target", "link", "whole", "netloc"))
    # First non-empty "u" parameter of the query part, decoded as a form value and once more.
    parameter = blank_to_null(F.regexp_extract(F.substring_index(url, "#", 1), r"^[^?]*\?(?:[^&]*&)*?u=([^&]+)", 1))
    form = F.replace(target, F.lit("+"), F.lit(" "))
    plus_kept = F.replace(F.coalesce(F.try_url_decode(form), form), F.lit("+"), F.lit("%2B"))
    unwrapped = F.coalesce(F.try_url_decode(F.col("_web_plus")), F.col("_web_plus"))
    wrapped = F.contains(url, F.lit("redirect?")) | F.contains(url, F.lit("u="))
    path = F.regexp_replace(F.regexp_extract(whole, r"^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    brackets = F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))
    steps = {
        "url": strip(F.translate(F.col(raw), "\u200b\ufeff\xa0", "")),
        "target": F.when(wrapped, parameter),
        "plus": plus_kept,
        "link": strip(F.when(target.isNotNull(), F.replace(unwrapped, F.lit("%2B"), F.lit("+"))).otherwise(url)),
        "whole": F.translate(F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit("https://"), link)), "\t\r\n", ""),
        "netloc": F.regexp_extract(whole, r"^https?://([^/?#]*)", 1),
        "host": F.regexp_replace(strip(F.lower(netloc)), r"^www\.", ""),
        "path": strip(F.rtrim(path, F.lit("/"))),
    }
    for name, step in steps.items():
        df = df.withColumn(f"_web_{name}", step)
    clean = F.when(brackets, whole).otherwise(F.concat(F.lit("https://"), F.col("_web_host"), F.col("_web_path")))
    return df.withColumn(out, F.when(link != "", strip(clean))).drop(*[f"_web_{k}" for k in steps])
