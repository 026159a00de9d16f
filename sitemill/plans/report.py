"""HTML card report over stored items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions.text import blank_to_null, escape_html
from sitemill.operators.ranking import number_rows

# Card and page markup.
CARD = '<div class="card">\n<h2>%s</h2>\n<p>%s</p>\n<a href="%s">%s</a>\n</div>'
EMPTY = '<p class="empty">No rows yet.</p>'


def cards(items: DataFrame) -> DataFrame:
    """Items with a ``card`` column: escaped text, null as empty, a missing link as ``#``."""
    link = F.coalesce(F.col("source_url"), F.lit(""))
    return items.withColumn(
        "card",
        F.format_string(
            CARD,
            escape_html(F.coalesce(F.col("company_name"), F.lit(""))),
            escape_html(F.coalesce(F.col("summary"), F.lit(""))),
            escape_html(F.coalesce(blank_to_null(F.col("source_url")), F.lit("#"))),
            escape_html(link),
        ),
    )


# What stands before and after the cards.
HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><title>%s</title></head>\n<body>\n<h1>%s</h1>\n<p class="subtitle">%d row(s)</p>'
FOOT = "</body>\n</html>"


def page(items: DataFrame, title: str = "Scraped items") -> DataFrame:
    """The page as rows ``position, html``: head, all cards from the newest on, foot.

    Written in order of position, the rows are the page; no row and no task holds all of it.
    """
    age = -F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = cards(items).select(age.alias("age"), F.coalesce("company_name", F.lit("")).alias("name"), "card")
    numbered = number_rows(rows, ["age", "name", "card"], "position", F.lit(0)).select(F.col("position").cast("long"), F.col("card").alias("html"))
    total = items.agg(F.count(F.lit(1)).alias("total"))
    head = F.format_string(HEAD, escape_html(F.lit(title)), escape_html(F.lit(title)), F.col("total"))
    empty = F.when(F.col("total") == 0, F.struct(F.lit(1).cast("long").alias("position"), F.lit(EMPTY).alias("html")))
    frame = total.select(
        F.array_compact(
            F.array(
                F.struct(F.lit(0).cast("long").alias("position"), head.alias("html")),
                empty,
                F.struct((F.greatest("total", F.lit(1)) + 1).cast("long").alias("position"), F.lit(FOOT).alias("html")),
            )
        ).alias("parts")
    )
    return numbered.unionByName(frame.select(F.explode("parts").alias("part")).select("part.position", "part.html"))
