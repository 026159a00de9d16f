"""Column functions against plain Python statements of what they mean."""

from urllib.parse import parse_qs, unquote, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitemill.functions import scoring, text


def apply(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.select(fn(F.col("v")), "i").orderBy("i").collect()]


def website(raw):
    """What a cleaned link must be, by the standard URL functions."""
    if not raw:
        return None
    url = raw
    for ch in "​﻿\xa0":
        url = url.replace(ch, "")
    url = url.strip()
    if "redirect?" in url or "u=" in url:
        target = parse_qs(urlparse(url).query).get("u")
        url = unquote(target[0]) if target else url
    url = url.strip()
    if not url:
        return None
    if not url.startswith(("http://", "https://")):
        url = "https://" + url
    p = urlparse(url)
    return ("https://" + p.netloc.lower().strip().removeprefix("www.") + p.path.rstrip("/").strip()).strip()


SITES = [
    None,
    "",
    "  ",
    "​",
    "Example.com",
    "http://www.Example.com/Path/?q=1#frag",
    "https://r.example/redirect?u=https%3A%2F%2Fwww.site.example%2Fa%3Fb%3D1",
    "https://r.example/redirect?u=&u=http%253A%252F%252Fx.example%252F",
    "https://r.example/go?a=1&u=site.example/a+b%20c",
    "https://r.example/go?bu=1&v=2",
    "https://r.example/go?u=%ZZsite",
    "﻿ www.site.example/a;p/b;q=1/ \xa0",
    "HTTP://UPPER.example/x",
    "https://host.example:8080//a//",
    "https://host.example?u=x.example#u=y.example",
    "//no.scheme.example/p",
    "http://www.www.example/",
]


def cleaned(spark, values):
    df = text.clean_website(spark.createDataFrame(list(enumerate(values)), "i int, v string"), "v", "out")
    return [r["out"] for r in df.orderBy("i").collect()]


def test_clean_website(spark):
    assert cleaned(spark, SITES) == [website(s) for s in SITES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab.:/?&=u#w%2+; ​", max_size=30), min_size=20, max_size=40))
def test_clean_website_generated(spark, urls):
    urls = [u for u in urls if "%" not in u]
    assert cleaned(spark, urls) == [website(u) for u in urls]


def test_strip_is_unicode_aware(spark):
    values = ["　\t a\xa0b \x1c", "​ x", ""]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


def test_routing_host(spark):
    got = apply(
        spark,
        [" HTTPS://www.GitHub.com:80/x", "github.com?a=1/b", "http://https://x.example/", "www.http://y", "demo-site"],
        text.routing_host,
    )
    assert got == ["github.com", "github.com?a=1", "https", "http", "demo-site"]


def test_page_urls(spark):
    df = spark.createDataFrame([("https://a.example/l", 3), ("https://a.example/l?x=1", 0), ("b", 1)], "u string, n int")
    got = [r[0] for r in df.select(text.page_urls(F.col("u"), F.col("n"))).collect()]
    assert got[0] == ["https://a.example/l", "https://a.example/l?page=1", "https://a.example/l?page=2"]
    assert len(got[1]) == 10 and got[1][9] == "https://a.example/l?x=1&page=9"
    assert got[2] == ["b"]


def test_lead_score(spark):
    rows = [
        ("4.9", 31, "$50,000+", 100),
        ("4.8.1", 100, "$50,000+", 50),
        ("4.5", None, "$50,000+", 60),
        ("4.5", 11, "$250,000+", 85),
        (None, 5, None, 50),
        ("n/a", 50, "$10,000+", 50),
        ("4.9 stars", 31, "$5,000", 85),
        ("", 12, "$25,000", 70),
    ]
    df = spark.createDataFrame(rows, "r string, n int, s string, want int")
    got = df.select(scoring.lead_score(F.col("r"), F.col("n"), F.col("s")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


@pytest.mark.parametrize(
    ("number", "valid"),
    [("5901234123457", True), ("5901234123456", False), ("96385074", True), ("036000291452", True), ("123", False), ("", False), ("00000000000000", True), ("9" * 20, False)],
)
def test_gtin(spark, number, valid):
    df = spark.createDataFrame([(number,)], "d string")
    df = df.withColumn("n", F.col("d").try_cast("bigint"))
    assert bool(df.select(scoring.gtin_valid("d", "n")).first()[0]) is valid


def test_html(spark):
    assert apply(spark, ["<b>a</b> &amp;lt; &lt;"], text.strip_html) == ["a &lt; <"]
    assert apply(spark, ["<a href=\"x\">'&amp;'</a>"], text.escape_html) == [
        "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;amp;&#x27;&lt;/a&gt;"
    ]
