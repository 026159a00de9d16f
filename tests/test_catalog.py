"""Catalog rules, quarantine, validators, gate and export on small feeds."""

import csv
import glob
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sitemill.operators import lookup
from sitemill.plans import catalog
from sitemill.sources import feeds

FEED = "sku string, title string, gtin string, price double, brand string, category string, stock long"


def frame(spark, *rows):
    base = dict.fromkeys([c.split()[0] for c in FEED.split(", ")])
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], FEED)


def enriched(spark, *rows):
    return {r["sku"]: r for r in catalog.enrich(frame(spark, *rows)).collect()}


GOOD = "5901234123457"


def test_two_row_feed(spark):
    df = spark.createDataFrame(
        [("SKU-1", "Apple iPhone case black", GOOD, 19.99), ("SKU-2", "mystery gadget", None, None)],
        "sku string, title string, gtin string, price double",
    )
    got = {r["sku"]: r for r in catalog.enrich(df).collect()}
    assert got["SKU-1"]["brand"] == "Apple" and got["SKU-1"]["color"] == "Black"
    # "phone case" is inside "iphone case", so the first row has a category and is clean.
    assert got["SKU-1"]["category"] == "Accessories > Phone Cases"
    assert not got["SKU-1"]["quarantine"] and got["SKU-2"]["quarantine"]
    assert [p["rule_id"] for p in got["SKU-2"]["predictions"]] == ["gtin", "brand", "color", "category", "price"]


def test_confidences(spark):
    r = enriched(spark, {"sku": "a", "title": "Samsung charger", "gtin": "12", "brand": " ", "price": 200000.0})["a"]
    got = {p["rule_id"]: (p["value"], p["confidence"], p["message"]) for p in r["predictions"]}
    assert got["gtin"] == ("12", 0.2, "invalid checksum")
    assert got["brand"] == ("Samsung", 0.75, "found in title")
    assert got["color"] == (None, 0.0, "color not found")
    assert got["category"] == ("Electronics > Chargers", 0.7, "keyword map")
    assert got["price"][1:] == (0.4, "suspiciously high")
    assert [p["rule_id"] for p in r["low_conf"]] == ["gtin", "brand", "color", "price"]


def test_quarantine_rules(spark):
    ok = {"title": "plain", "gtin": GOOD, "brand": "Other", "category": "C", "price": 5.0}
    got = enriched(
        spark,
        ok | {"sku": "ok"},
        ok | {"sku": "lower alias", "brand": "apple"},
        ok | {"sku": "dashed", "gtin": "590-1234123457"},
        ok | {"sku": "zero", "price": 0.0},
        ok | {"sku": "no price", "price": None},
        ok | {"sku": "no gtin", "gtin": None},
        ok | {"sku": "no category", "category": None},
        ok | {"sku": "keyword", "category": "", "title": "a shirt"},
    )
    held = {k for k, r in got.items() if r["quarantine"]}
    assert held == {"lower alias", "dashed", "zero", "no category"}
    assert got["keyword"]["category"] == "Apparel > Shirts"
    assert got["no price"]["price"] is None


def test_ean_fills_gtin(spark):
    df = spark.createDataFrame([("a", None, GOOD, "C")], "sku string, gtin string, ean string, category string")
    assert catalog.enrich(df).first()["gtin"] == GOOD


def test_cyrillic_colors(spark):
    df = spark.createDataFrame([("ЧЁРН чехол",), ("Красн мяч",), ("черный",)], "title string")
    assert [r["color"] for r in catalog.enrich(df).collect()] == ["Black", "Red", None]


def test_validators_order_and_counts(spark):
    df = frame(
        spark,
        {"sku": "", "gtin": "123", "price": -1.0, "stock": -2},
        {"sku": "b", "gtin": "", "price": None, "stock": None},
    )
    rows = [(r["sku"], r["field"], r["severity"]) for r in catalog.issues(df).collect()]
    assert rows == [
        ("", "gtin", "error"),
        ("", "price", "error"),
        ("", "stock", "error"),
        ("", "sku", "error"),
        ("b", "price", "warning"),
    ]


def test_normalize_is_lenient(spark):
    df = spark.createDataFrame([("\xa0 x ", "1.5", "7"), (None, "abc", "3.0")], "sku string, price string, stock string")
    rows = catalog.normalize(df).collect()
    assert [tuple(r) for r in rows] == [("x", 1.5, 7), (None, None, 0)]
    assert catalog.normalize(spark.range(1)).columns == ["id"]


def test_profile_counts_nulls_of_first_columns(spark):
    df = spark.createDataFrame([(None, 1), (None, None)], "a int, b int")
    got = [(r["column_name"], r["row_count"], r["null_count"]) for r in catalog.profile(df, 1).collect()]
    assert got == [("a", 2, 2), ("b", 2, None)]


def test_run_exports_and_refuses(spark, tmp_path):
    ok = {"title": "plain", "gtin": GOOD, "brand": "Other", "category": "C", "price": 5.0, "stock": 1}
    feed = frame(spark, ok | {"sku": "a"}, ok | {"sku": "b", "brand": "apple"})
    out = str(tmp_path / "out")
    totals = catalog.run(feed, out, "feed.csv")
    assert totals["clean_count"] + totals["quarantine_count"] == totals["row_count"] == 2
    assert [r["sku"] for r in spark.read.option("header", True).csv(f"{out}/catalog.csv").collect()] == ["a"]
    assert [r["sku"] for r in spark.read.option("header", True).csv(f"{out}/quarantine.csv").collect()] == ["b"]
    assert catalog.stored(spark, out, "import_runs").first()["status"] == "passed"
    assert {r["qa_status"] for r in catalog.stored(spark, out, "staging").collect()} == {"passed", "quarantine"}

    bad = str(tmp_path / "bad")
    with pytest.raises(catalog.GateError):
        catalog.run(frame(spark, ok | {"sku": "a", "stock": -1}), bad, "feed.csv")
    assert not glob.glob(f"{bad}/catalog.csv") and catalog.stored(spark, bad, "qa_issues").count() == 1
    assert catalog.stored(spark, bad, "import_runs").first()["status"] == "failed"


def test_no_quarantined_rows_when_empty(spark, tmp_path):
    ok = {"sku": "a", "title": "plain", "gtin": GOOD, "brand": "Other", "category": "C", "price": 5.0, "stock": 1}
    out = str(tmp_path / "o")
    catalog.run(frame(spark, ok, {"sku": "b", "title": "thing", "price": 1.0}), out, "f")
    assert feeds.read_feed(spark, f"{out}/quarantine.csv").count() == 1
    for _ in range(2):  # the second run, and the same tried again
        catalog.run(frame(spark, ok), out, "f", import_run_id=2)
    assert not glob.glob(f"{out}/quarantine.csv") and catalog.stored(spark, out, "import_runs").count() == 2
    assert catalog.stored(spark, out, "staging").groupBy("import_run_id").count().orderBy("import_run_id").collect() == [(1, 2), (2, 1)]


def test_rules_are_not_repeated_in_the_plan(spark, tmp_path):
    frame(spark, {"sku": "a"}).write.parquet(str(tmp_path / "feed"))
    e = catalog.enrich(spark.read.parquet(str(tmp_path / "feed")))
    for df in (e, catalog.prediction_rows(e), catalog.issues(e), catalog.rollup(e)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_replace") <= 4 and "Exchange hashpartitioning" not in plan


def test_read_feed_formats(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5)], "sku string, price double")
    df.write.option("header", True).csv(str(tmp_path / "f.csv"))
    df.write.json(str(tmp_path / "f.json"))
    df.write.parquet(str(tmp_path / "f.pq"))
    (tmp_path / "arr.json").write_text('[{"sku": "1"},\n {"sku": "2"}]')
    assert feeds.read_feed(spark, str(tmp_path / "f.csv")).first()["sku"] == "007"
    assert feeds.read_feed(spark, str(tmp_path / "f.json")).count() == 1
    assert feeds.read_feed(spark, str(tmp_path / "f.pq")).count() == 1
    assert feeds.read_feed(spark, str(tmp_path / "arr.json"), array=True).count() == 2
    with pytest.raises(ValueError):
        feeds.read_feed(spark, str(tmp_path / "f.xlsx"))


def test_csv_both_ways_is_standard(spark, tmp_path):
    texts = ['5" bolt, zinc', "two\nlines", "  padded  ", 'a""b', "back\\slash", 'ends "', "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, title string")
    feeds.export_csv(df, str(tmp_path / "f.csv"))
    assert sorted((int(r["row"]), r["title"]) for r in feeds.read_feed(spark, str(tmp_path / "f.csv")).collect()) == list(enumerate(texts))
    files = duckdb.sql(f"SELECT row, title FROM read_csv('{tmp_path}/f.csv/*.csv', header = true, quote = '\"', escape = '\"')").fetchall()
    assert sorted(files) == list(enumerate(texts))
    with open(tmp_path / "g.csv", "w", newline="") as f:
        csv.writer(f).writerows([["row", "title"], *enumerate(texts)])
    assert sorted((int(r["row"]), r["title"]) for r in feeds.read_feed(spark, str(tmp_path / "g.csv")).collect()) == list(enumerate(texts))


def test_price_that_is_no_number_is_not_too_high(spark):
    row = {r["rule_id"]: r for r in catalog.prediction_rows(catalog.enrich(frame(spark, {"sku": "a", "price": float("nan")})), "sku").collect()}
    assert row["price"]["message"] == "price ok"


def test_maps(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "brand string")
    m = spark.createDataFrame([("A", "Alpha"), ("B", None)], "raw string, canonical string")
    assert {r[0] for r in lookup.apply_map(df, m).collect()} == {"Alpha", "B", None}
    assert lookup.apply_map(spark.range(2), m).columns == ["id"]


def test_first_contained_takes_dictionary_order(spark):
    df = spark.createDataFrame([(1, "Red BOLT ring"), (2, "ring"), (3, None), (4, "bo")], "i int, t string")
    needles = spark.createDataFrame([("ring", "R", 2), ("bolt", "B", 1), ("", "E", 0)], "needle string, value string, rank int")
    got = {r["i"]: r["c"] for r in lookup.first_contained(df, "t", needles, "c").collect()}
    assert got == {1: "B", 2: "R", 3: None, 4: None}


def test_first_contained_by_definition(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    needles = [(word(rng.randrange(0, 5)), f"v{i}", rng.randrange(30)) for i in range(60)]
    texts = [None, "", *[word(rng.randrange(0, 25)).upper() for _ in range(300)]] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    dictionary = spark.createDataFrame(needles, "needle string, value string, rank int")

    def want(text):
        hits = [(r, n, v) for n, v, r in needles if n and n in (text or "").lower()]
        return min(hits)[2] if hits else None

    for part_bytes in (1 << 20, 500):  # one automaton, and several
        found = lookup.first_contained(df, "t", dictionary, "c", part_bytes)
        assert {r["i"]: r["c"] for r in found.collect()} == {i: want(t) for i, t in enumerate(texts)}
        assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    assert lookup.first_contained(df, "t", dictionary.limit(0), "c").where("c IS NOT NULL").isEmpty()


def test_hot_value_in_a_map_keeps_all_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("brand"))
    m = spark.createDataFrame([("hot", "H")], "raw string, canonical string")
    assert lookup.apply_map(df, m).filter("brand = 'H'").count() == 1000
