"""Record scoring and identifier checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemill.functions.text import blank_to_null


def lead_score(rating: Column, reviews: Column, project_size: Column) -> Column:
    """Lead quality from 50 to 100.

    The parts are scored in order, and an unusable value stops the scoring: a rating
    text without a number skips everything, missing reviews skip the project size.
    """
    number = F.regexp_replace(rating, "[^\\d.]", "").try_cast("double")
    has_rating = blank_to_null(rating).isNotNull()
    rating_points = (
        F.when(number >= 4.8, 20).when(number >= 4.5, 10).otherwise(0)
    )
    review_points = F.when(reviews > 30, 15).when(reviews > 10, 10).otherwise(0)

    def mentions(*sums: str) -> Column:
        hit = F.lit(False)
        for s in sums:
            hit = hit | F.contains(project_size, F.lit(s))
        return hit

    # The project sizes that score.
    size_points = (
        F.when(mentions("50,000", "100,000"), 15)
        .when(mentions("10,000", "25,000"), 10)
        .otherwise(0)
    )
    score = (
        F.when(has_rating & number.isNull(), 50)
        .when(reviews.isNull(), 50 + rating_points)
        .otherwise(50 + rating_points + review_points + size_points)
    )
    return F.least(score, F.lit(100)).cast("int")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "\\D", "")


def gtin_valid(number: str, value: str) -> Column:
    """Whether the named column of digits is an EAN/GTIN of 8, 12, 13 or 14 digits with a
    right check digit; ``value`` names the same digits as a bigint."""
    # One SQL text over two plain columns: integer arithmetic, no text per digit.
    total = " + ".join(
        f"({value} div {10**i}L) % 10 * {3 if i % 2 else 1}" for i in range(14)
    )
    return F.expr(f"length({number}) IN (8, 12, 13, 14) AND ({total}) % 10 = 0")
