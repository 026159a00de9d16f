"""Routing, record extraction, outcomes and validity."""

import pytest
from pyspark.sql import functions as F

from sitemill.operators import extract, routing

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<h1>no</h1>";</script></head><body>
<div class="listing"><h2>Nord &amp; Co</h2><p>Ships <b>freight</b> by rail.</p></div>
<div class="listing"><h2>Ostra</h2></div>
<div class="big card">Wide <i>card</i><style>p{}</style></div><ul><li>x</li></ul><p>After the list.</p>
<h3> a </h3><h1></h1></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def registry(spark):
    return spark.createDataFrame(
        [("demo-site", ["demo_site.example"]), ("aa_hub", ["GitHub.com"]), ("zz", ["docs.github.com", "github.com"])],
        "extractor_id string, domains array<string>",
    )


def test_routing(spark):
    urls = {
        "https://github.com/x": "aa_hub",
        "https://docs.github.com/x": "aa_hub",
        "https://www.github.com:443": "aa_hub",
        "https://github.com.evil-phishing.example/x": None,
        "https://notgithub.com/x": None,
        "demo-site": "demo_site",
        "DEMO_SITE ": "demo_site",
        "https://demo-site/": None,
        "http://a.demo_site.example/": "demo_site",
        "": None,
    }
    df = pages(spark, *[(u, "") for u in urls], (None, ""))
    got = {r["url"]: r["extractor_id"] for r in routing.route(df, registry(spark)).collect()}
    assert got == urls | {None: None}


def test_routing_keeps_a_hot_host_whole(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "https://github.com/x").otherwise(F.concat(F.lit("https://h"), "id", F.lit(".example"))).alias("url")
    )
    routed = routing.route(df, registry(spark))
    assert routed.count() == 3000 and routed.filter("extractor_id = 'aa_hub'").count() == 1000


def test_small_registry_is_broadcast(spark, tmp_path):
    pages(spark, ("https://github.com/x", "")).write.parquet(str(tmp_path / "p"))
    routed = routing.route(spark.read.parquet(str(tmp_path / "p")), registry(spark))
    routed.collect()
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pages_by_code_and_by_column(spark):
    rows = [(1, "https://a.example/x", "own", 3), (2, "https://b.example/x?y=1", "other", 2), (3, "https://c.example/", None, 1), (4, None, "own", 2), (5, "https://d.example/", "own", None), (6, "https://e.example/", "stops", 9)]
    df = spark.createDataFrame(rows, "page_id int, url string, extractor_id string, n int")

    def stops(base, pages):
        """Pages until the cursor says so."""
        cursor = len(base)
        while cursor % 7 and pages:
            yield f"{base}?c={cursor}"
            cursor, pages = cursor * 3 + 1, pages - 1

    coded = {"own": lambda base, pages: (f"{base}/{'i' * i}" for i in range(pages)), "stops": stops}
    got = {}
    for r in routing.page_rows(df, F.col("n"), {}, coded).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["page_url"])
    assert got[1] == ["https://a.example/x/", "https://a.example/x/i", "https://a.example/x/ii"]
    assert got[2] == ["https://b.example/x?y=1", "https://b.example/x?y=1&page=1"] and got[3] == ["https://c.example/"]
    assert 4 not in got and len(got[5]) == 10 and got[6] == list(stops("https://e.example/", 9))
    plan = routing.page_rows(df.where("extractor_id = 'other'"), F.col("n"), {}, {})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_cards_parser():
    got = extract.cards_parser("dir")(PAGE, "http://p")
    assert [(r["company_name"], r["summary"]) for r in got] == [
        ("Nord & Co", "Ships freight by rail."),
        ("Ostra", "Ostra"),
        ("Wide card", "After the list."),
    ]
    assert {(r["source_url"], r["source_directory"], r["website"]) for r in got} == {("http://p", "dir", None)}


def test_unclosed_tags_nest():
    got = extract.cards_parser("d")("<h1>One</h1><p>a<br><p>b</p></i>c", "u")
    assert [r["summary"] for r in got] == ["a b c"]


def test_extract_records_and_errors(spark):
    def broken(html, url):
        raise KeyError("selector")

    df = pages(spark, ("https://github.com/a", PAGE), ("https://demo_site.example/", "x"), ("https://other.example", PAGE), ("zz", ""))
    routed = routing.route(df, registry(spark))
    parsers = {"aa_hub": extract.cards_parser("aa_hub"), "demo_site": broken}
    records, errors = extract.extract_records(routed, parsers)
    assert [(r["page_id"], r["ord"]) for r in records.orderBy("ord").collect()] == [(0, 0), (0, 1), (0, 2)]
    assert {r["page_id"]: r["error"] for r in errors.collect()} == {1: "KeyError: 'selector'", 3: "LookupError: no parser for zz"}


def test_custom_records(spark):
    routed = pages(spark, ("u", "h")).withColumn("extractor_id", F.lit("x"))
    records, _ = extract.extract_records(routed, {"x": lambda h, u: [{"company_name": "A", "rank": 3}, {}, "junk", None]})
    rows = records.orderBy("ord").collect()
    assert rows[0]["attrs"] == {"rank": "3"} and [r["record_size"] for r in rows] == [2, 0, 0, 0]
    valid = extract.valid_records(records, ["page_id"]).first()
    assert (valid["status"], valid["items_scraped"], valid["discarded"]) == ("SUCCESS", 1, 3)
    filled = extract.ensure_source_url(records, F.lit("u")).first()
    assert filled["source_url"] == "u"


def test_validity_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "run int, record_size int")
    r = extract.valid_records(df, ["run"]).first()
    assert (r["status"], r["items_scraped"], r["discarded"]) == ("ZERO_ROWS", 0, 2)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(200, True, 2), (404, False, 0)], ("SUCCESS", 2, 1)),
        ([(200, True, 0), (403, True, 5)], ("ZERO_ROWS", 0, 1)),
        ([(200, False, 1), (429, True, 0)], ("FAILED", 0, 0)),
    ],
)
def test_run_outcomes(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "run int, status_code int, has_content boolean, items int")
    r = extract.run_outcomes(df, "run").first()
    assert (r["status"], r["items_scraped"], r["http_200_count"]) == want


def test_fetch_outcome(spark):
    df = spark.createDataFrame([(200, 1), (200, 0), (500, 0)], "s int, n int")
    assert [r[0] for r in df.select(extract.fetch_outcome(F.col("s"), F.col("n"))).collect()] == ["SUCCESS", "ZERO_ROWS", "FAILED"]
