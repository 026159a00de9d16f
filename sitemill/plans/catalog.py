"""Product catalog quality: profile, normalise, rules, quarantine, validators, gate, export."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill import constants as K
from sitemill.functions.scoring import digits, gtin_valid
from sitemill.functions.text import blank_to_null, strip
from sitemill.session import materialize, remove
from sitemill.sources.commits import read_batches, write_batch
from sitemill.sources.feeds import export_csv

TEXT_FIELDS = ("sku", "gtin", "brand", "title", "category", "parent_sku")


@dataclass(frozen=True)
class Guess:
    """What a rule says about a row: columns over the feed and the rule's facts."""

    value: Column
    confidence: Column
    message: Column


@dataclass(frozen=True)
class Rule:
    """A catalog rule that predicts the field it is named after.

    ``facts`` are intermediate columns, computed once in stages (a stage may use the one
    before); ``guess`` reads them. Keeping them as columns stops long expressions from
    being repeated in every place that uses a prediction.
    """

    rule_id: str
    facts: Callable[[DataFrame], list[dict[str, Column]]]
    guess: Callable[[], Guess]


def _choose(
    *options: tuple[Column, Column, float, str], missing: tuple[float, str], kind: str = "string"
) -> Guess:
    """The first option whose condition holds: (condition, value, confidence, message)."""
    value = F.lit(None).cast(kind)
    confidence, message = F.lit(float(missing[0])), F.lit(missing[1])
    for holds, v, c, m in reversed(options):
        value = F.when(holds, v.cast(kind)).otherwise(value)
        confidence = F.when(holds, F.lit(float(c))).otherwise(confidence)
        message = F.when(holds, F.lit(m)).otherwise(message)
    return Guess(value, confidence, message)


def profile(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Row count of the feed and null count of its columns, or of the first few, from one aggregate."""
    counted = df.columns[:max_columns]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(counted)]
    totals = df.agg(F.count("*").alias("row_count"), *nulls)
    pairs = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(c).alias("column_name"),
            (F.col(f"n{i}") if i < len(counted) else F.lit(None).cast("long")).alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return totals.select("row_count", F.inline(F.array(*pairs)))


def normalize(df: DataFrame) -> DataFrame:
    """Strip text fields, parse price and stock leniently; only columns that exist are touched."""
    have = set(df.columns)
    out = {c: strip(F.col(c).cast("string")) for c in TEXT_FIELDS if c in have}
    if "price" in have:
        out["price"] = F.col("price").try_cast("double")
    if "stock" in have:
        out["stock"] = F.coalesce(F.col("stock").try_cast("long"), F.lit(0).cast("long"))
    return df.withColumns(out) if out else df


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _first_contained(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Value of the first needle, in dictionary order, that ``text`` contains."""
    hit = F.lit(None).cast("string")
    for needle, value in reversed(list(pairs)):
        hit = F.when(F.contains(text, F.lit(needle)), F.lit(value)).otherwise(hit)
    return hit


def gtin_rule() -> Rule:
    def facts(df: DataFrame) -> list[dict[str, Column]]:
        raw = F.coalesce(blank_to_null(_field(df, "gtin")), blank_to_null(_field(df, "ean")), F.lit(""))
        return [
            {"_digits": digits(raw)},
            {"_number": F.col("_digits").try_cast("bigint")},
            {"_gtin_ok": gtin_valid("_digits", "_number")},
        ]

    def guess() -> Guess:
        number = F.col("_digits")
        return _choose(
            (number == "", F.lit(None), 0.0, "missing gtin"),
            (F.col("_gtin_ok"), number, 1.0, "valid ean/gtin"),
            (F.lit(True), number, 0.2, "invalid checksum"),
            missing=(0.0, "missing gtin"),
        )

    return Rule("gtin", facts, guess)


def brand_rule(aliases: dict[str, str]) -> Rule:
    def facts(df: DataFrame) -> list[dict[str, Column]]:
        title = F.lower(F.coalesce(_field(df, "title"), F.lit("")))
        key = F.lower("_brand")
        alias = F.lit(None).cast("string")
        for needle, canonical in aliases.items():
            alias = F.when(key == needle, F.lit(canonical)).otherwise(alias)
        return [
            {"_brand": strip(F.coalesce(_field(df, "brand"), F.lit("")))},
            {"_alias": alias, "_brand_seen": _first_contained(title, list(aliases.items()))},
        ]

    def guess() -> Guess:
        brand, alias, seen = F.col("_brand"), F.col("_alias"), F.col("_brand_seen")
        return _choose(
            ((brand != "") & alias.isNotNull(), alias, 0.95, "alias map"),
            (brand != "", brand, 0.85, "supplier brand kept"),
            (seen.isNotNull(), seen, 0.75, "found in title"),
            missing=(0.0, "brand unknown"),
        )

    return Rule("brand", facts, guess)


def color_rule(words: Sequence[tuple[str, str]]) -> Rule:
    def facts(df: DataFrame) -> list[dict[str, Column]]:
        text = F.concat(
            F.coalesce(_field(df, "title"), F.lit("")),
            F.lit(" "),
            F.coalesce(_field(df, "description"), F.lit("")),
        )
        label = F.lit(None).cast("string")
        for pattern, name in reversed(list(words)):
            label = F.when(F.col("_text").rlike(rf"(?iU)\b({pattern})\b"), F.lit(name)).otherwise(label)
        return [{"_text": text, "_color": blank_to_null(_field(df, "color"))}, {"_hue": label}]

    def guess() -> Guess:
        given, hue = F.col("_color"), F.col("_hue")
        return _choose(
            (given.isNotNull(), strip(given), 0.9, "already set"),
            (hue.isNotNull(), hue, 0.8, "regex match"),
            missing=(0.0, "color not found"),
        )

    return Rule("color", facts, guess)


def category_rule(keywords: Sequence[tuple[str, str]]) -> Rule:
    def facts(df: DataFrame) -> list[dict[str, Column]]:
        title = F.lower(F.coalesce(_field(df, "title"), F.lit("")))
        return [
            {
                "_category": blank_to_null(_field(df, "category")),
                "_category_seen": _first_contained(title, keywords),
            }
        ]

    def guess() -> Guess:
        given, seen = F.col("_category"), F.col("_category_seen")
        return _choose(
            (given.isNotNull(), strip(given), 0.9, "supplier category"),
            (seen.isNotNull(), seen, 0.7, "keyword map"),
            missing=(0.0, "category unknown"),
        )

    return Rule("category", facts, guess)


def price_rule() -> Rule:
    def facts(df: DataFrame) -> list[dict[str, Column]]:
        if "price" in df.columns and df.schema["price"].dataType.simpleString() != "string":
            # Already a number: no way through text.
            return [{"_no_price": F.col("price").isNull(), "_price": F.col("price").cast("double")}]
        raw = blank_to_null(_field(df, "price"))
        return [{"_no_price": raw.isNull(), "_price": raw.try_cast("double")}]

    def guess() -> Guess:
        price = F.col("_price")
        return _choose(
            (F.col("_no_price"), F.lit(None), 0.0, "missing price"),
            (price.isNull(), F.lit(None), 0.1, "not a number"),
            (price <= 0, price, 0.1, "price must be > 0"),
            # Not a number is not above any limit here, though Spark sorts it last.
            (~F.isnan(price) & (price > K.PRICE_CEILING), price, 0.4, "suspiciously high"),
            (F.lit(True), price, 0.95, "price ok"),
            missing=(0.0, "missing price"),
            kind="double",
        )

    return Rule("price", facts, guess)


def rule_pack(
    aliases: dict[str, str] = K.BRAND_ALIASES,
    colors: Sequence[tuple[str, str]] = K.COLOR_WORDS,
    keywords: Sequence[tuple[str, str]] = K.CATEGORY_KEYWORDS,
) -> list[Rule]:
    """The five rules in order.

    The dictionaries are literals of the plan, meant for word lists of a few hundred
    entries; ``operators.lookup`` joins larger ones.
    """
    return [gtin_rule(), brand_rule(aliases), color_rule(colors), category_rule(keywords), price_rule()]


def _guessed(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``_v_<rule>, _c_<rule>, _m_<rule>`` (value, confidence, message) per rule."""
    staged = [r.facts(df) for r in rules]
    out, made = df, []
    for n in range(max(len(s) for s in staged)):
        stage = {k: c for s in staged if n < len(s) for k, c in s[n].items()}
        out = out.withColumns(stage)
        made += stage
    guesses = {}
    for r in rules:
        g = r.guess()
        guesses |= {f"_v_{r.rule_id}": g.value, f"_c_{r.rule_id}": g.confidence, f"_m_{r.rule_id}": g.message}
    return out.withColumns(guesses).drop(*made)


def _prediction(rule: Rule) -> Column:
    r = rule.rule_id
    return F.struct(
        F.lit(r).alias("rule_id"),
        F.lit(r).alias("field"),
        F.col(f"_v_{r}").cast("string").alias("value"),
        F.col(f"_c_{r}").alias("confidence"),
        F.col(f"_m_{r}").alias("message"),
    )


def predict(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add ``predictions``: array<struct<rule_id, field, value, confidence, message>>."""
    rules = rules or rule_pack()
    out = _guessed(df, rules).withColumn("predictions", F.array(*[_prediction(r) for r in rules]))
    return out.select(*[c for c in df.columns if c != "predictions"], "predictions")


def enrich(
    df: DataFrame, rules: list[Rule] | None = None, floor: float = K.CONFIDENCE_FLOOR
) -> DataFrame:
    """Merge sure predictions into empty fields and flag rows to hold back.

    Adds ``predictions``, ``low_conf`` and ``quarantine``. Row-local: no shuffle.
    """
    rules = rules or rule_pack()
    flags: dict[str, Column] = {}
    merged: dict[str, Column] = {}
    for rule in rules:
        r = rule.rule_id
        value, confidence = F.col(f"_v_{r}"), F.col(f"_c_{r}")
        ok = value.isNotNull() & (confidence > 0)
        sure = ok & (confidence >= floor)
        if r in df.columns:
            own, own_type = F.col(r), df.schema[r].dataType.simpleString()
            empty = own.isNull() | (own.cast("string") == "")
            # Numbers are compared as numbers: their text form differs between engines.
            typed = value.try_cast(own_type)
            clash = sure & ~empty & (own != typed)
            merged[r] = F.when(sure & empty, typed).otherwise(own)
        else:
            clash = F.lit(False)
            merged[r] = F.when(sure, value)
        flags[f"_hold_{r}"] = F.coalesce((ok & ~sure) | clash, F.lit(False))
        flags[f"_note_{r}"] = ~ok & (confidence == 0) & (F.col(f"_m_{r}") != "")

    out = _guessed(df, rules).withColumns(flags)
    held = reduce(or_, [F.col(f"_hold_{r.rule_id}") for r in rules])
    notes = [
        F.when(F.col(f"_hold_{r.rule_id}") | F.col(f"_note_{r.rule_id}"), _prediction(r)) for r in rules
    ]
    out = out.withColumns(
        merged
        | {
            "predictions": F.array(*[_prediction(r) for r in rules]),
            "low_conf": F.array_compact(F.array(*notes)),
            "_held": held,
        }
    )
    no_category = blank_to_null(F.col("category")).isNull() if "category" in merged else F.lit(True)
    added = [r.rule_id for r in rules if r.rule_id not in df.columns]
    return out.select(
        *df.columns, *added, "predictions", "low_conf", (F.col("_held") | no_category).alias("quarantine")
    )


def prediction_rows(enriched: DataFrame, key: str = "sku") -> DataFrame:
    # Outer: otherwise Spark derives a filter on the array and computes all rules in it again.
    return enriched.select(key, F.inline_outer("predictions"))


def rule_hits(enriched: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows per rule with a usable prediction, counted even below the floor.

    One aggregate of conditional counts; no row is exploded.
    """
    ids = [r.rule_id for r in rules or rule_pack()]

    def usable(i: int) -> Column:
        p = F.col("predictions")[i]
        return p["value"].isNotNull() & (p["confidence"] > 0)

    counts = enriched.agg(*[F.count_if(usable(i)).alias(f"n{i}") for i in range(len(ids))])
    pairs = [
        F.struct(F.lit(r).alias("rule_id"), F.col(f"n{i}").alias("hits")) for i, r in enumerate(ids)
    ]
    return counts.select(F.inline(F.array(*pairs))).filter("hits > 0")


def _with_issues(df: DataFrame) -> DataFrame:
    """Add ``_issues``, the findings of a row: array<struct<field, severity, message, raw_value>>."""
    have = set(df.columns)

    def issue(when: Column, field: str, severity: str, message: str, raw: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(field).alias("field"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
                raw.cast("string").alias("raw_value"),
            ),
        )

    nothing = F.lit(None)
    found = []
    if "gtin" in have:
        gtin = blank_to_null(F.col("gtin").cast("string"))
        df = df.withColumn("_digits", digits(gtin))
        df = df.withColumn("_number", F.col("_digits").try_cast("bigint"))
        df = df.withColumn("_wrong", ~gtin_valid("_digits", "_number"))
        found.append(issue(F.col("_wrong"), "gtin", "error", "Invalid GTIN/EAN checksum", gtin))
    price = F.col("price") if "price" in have else F.lit(None).cast("double")
    found.append(issue(price.isNull(), "price", "warning", "Missing price", nothing))
    found.append(issue(price <= 0, "price", "error", "Price must be > 0", price))
    if "stock" in have:
        stock = F.col("stock")
        found.append(issue(stock < 0, "stock", "error", "Stock cannot be negative", stock))
    no_sku = F.coalesce(_field(df, "sku"), F.lit("")) == ""
    found.append(issue(no_sku, "sku", "error", "SKU is required", nothing))
    return df.withColumn("_issues", F.array_compact(F.array(*found))).drop("_digits", "_number", "_wrong")


def issues(df: DataFrame) -> DataFrame:
    """Validator findings, one row each: ``sku, field, severity, message, raw_value``."""
    sku = F.coalesce(_field(df, "sku"), F.lit(""))
    rows = _with_issues(df).select(sku.alias("sku"), F.inline_outer("_issues"))
    return rows.filter("field IS NOT NULL")


def rollup(enriched: DataFrame) -> DataFrame:
    """Row counts, and the issue counts of clean rows, in one aggregate."""
    held = F.col("quarantine")

    def found(severity: str) -> Column:
        n = F.size(F.filter(F.col("_issues"), lambda i: i["severity"] == severity))
        return F.coalesce(F.sum(F.when(~held, n)), F.lit(0))

    return _with_issues(enriched).agg(
        F.count("*").alias("row_count"),
        F.count_if(~held).alias("clean_count"),
        F.count_if(held).alias("quarantine_count"),
        found("error").alias("qa_errors"),
        found("warning").alias("qa_warnings"),
    )


def gate(rollup_row: DataFrame) -> DataFrame:
    """Export is allowed when clean rows have no error."""
    passed = F.col("qa_errors") == 0
    return rollup_row.select(
        passed.alias("passed"),
        "qa_errors",
        "qa_warnings",
        "quarantine_count",
        F.when(passed, "No GTIN/price/SKU errors")
        .otherwise(F.format_string("%d QA errors — fix before export", F.col("qa_errors")))
        .alias("description"),
    )


def split(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean and quarantined rows of a stored frame; their counts add up to the input.

    Give it a materialized frame: both parts are then filters pushed into one table, and
    the rules are not run again for each.
    """
    plain = enriched.drop("predictions", "low_conf")
    return (
        plain.filter("NOT quarantine").drop("quarantine"),
        plain.filter("quarantine").drop("quarantine"),
    )


def staging(enriched: DataFrame, import_run_id: int) -> DataFrame:
    """Rows for the staging table.

    ``row_hash`` and ``qa_status`` are columns of the staging schema that nothing fills;
    here they are the hash of the row and its verdict (an extension).
    """
    errors = F.exists(F.col("_issues"), lambda i: i["severity"] == "error")
    data = [F.col(c) for c in enriched.columns if c not in ("predictions", "low_conf", "quarantine")]
    return _with_issues(enriched).select(
        F.lit(import_run_id).alias("import_run_id"),
        *data,
        F.sha2(F.to_json(F.struct(*data)), 256).alias("row_hash"),
        F.when(F.col("quarantine"), "quarantine")
        .when(errors, "failed")
        .otherwise("passed")
        .alias("qa_status"),
    )


class GateError(RuntimeError):
    """Raised when clean rows have errors and the export is refused."""


def run(
    feed: DataFrame,
    out: str,
    source_path: str,
    import_run_id: int = 1,
    rules: list[Rule] | None = None,
    floor: float = K.CONFIDENCE_FLOOR,
) -> dict:
    """Normalise, enrich, validate and export one feed.

    Rows of ``staging``, ``qa_issues`` and ``import_runs`` below ``out`` are added in one commit in
    any case, once for each ``import_run_id`` however often it is tried (``stored`` reads them); the
    CSV exports are written only when the gate passes, the quarantine only when there is something in it. The
    enriched rows are computed once and kept in the shared folder for the passes over them.
    """
    spark = feed.sparkSession
    enriched = materialize(enrich(normalize(feed), rules, floor), "enriched")
    totals = rollup(enriched).first().asDict()
    passed = totals["qa_errors"] == 0
    clean, held = split(enriched)

    run_id = F.lit(import_run_id).alias("import_run_id")
    ledger = {
        "id": import_run_id,
        "source_path": source_path,
        "row_count": totals["row_count"],
        "qa_passed": totals["clean_count"],
        "qa_failed": totals["quarantine_count"],
        "status": "passed" if passed else "failed",
    }
    rows = {
        "staging": staging(enriched, import_run_id),
        "qa_issues": issues(enriched.filter("NOT quarantine")).select(run_id, "*"),
        "import_runs": spark.createDataFrame([ledger]).withColumn("created_at", F.current_timestamp()),
    }
    write_batch(spark, out, f"{import_run_id:08d}", rows)
    if not passed:
        raise GateError(f"{totals['qa_errors']} QA errors — fix before export")

    if totals["quarantine_count"]:
        export_csv(held, f"{out}/quarantine.csv")
    else:
        remove(spark, [f"{out}/quarantine.csv"])
    return totals | {"export_path": export_csv(clean, f"{out}/catalog.csv")}


def stored(spark: SparkSession, out: str, table: str) -> DataFrame:
    """``staging``, ``qa_issues`` or ``import_runs`` of all runs below ``out``."""
    return read_batches(spark, out, table)
