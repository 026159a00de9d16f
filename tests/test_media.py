"""Frames, contexts and cluster summaries."""

from pyspark.sql import functions as F

from sitemill.operators import media

ITEMS = "cluster_id int, ord int, type string, title string, speech_transcript string, ocr_text string, brand string"


def test_sample_frames(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((0, -3, 1, 4, 10, 23))], "i int, n long")
    got = {}
    for r in media.sample_frames(df, "n", 4).collect():
        got.setdefault(r["n"], []).append(r["frame"])
    assert got == {n: list(range(0, n, max(1, n // 4)))[:4] for n in (1, 4, 10, 23)}


def test_summaries(spark):
    rows = [
        (1, 2, None, "t2", "", "o2", "B"),
        (1, 1, "image", "t1", None, "", "A"),
        (1, 3, "image", "", "s3", "o3", "A"),
        (2, 1, "b", "", "", "", ""),
        (2, 2, "a", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ITEMS)
    known = spark.createDataFrame([(1,), (2,), (3,)], "cluster_id int")
    got = {r["cluster_id"]: r for r in media.summarize(df, known=known).collect()}
    assert (got[1]["hook"], got[1]["overlay"], got[1]["primary_media_type"], got[1]["brand_count"]) == ("s3", "o2", "image", 2)
    assert got[2]["hook"] == "Discover the ultimate solution today." and got[2]["overlay"] == "SPECIAL OFFER 50% OFF"
    assert (got[2]["primary_media_type"], got[2]["brand_count"]) == ("a", 0)
    assert (got[3]["status"], got[3]["message"], got[3]["generated_script"]) == ("error", "Cluster contains no items", None)
    assert {tuple(r) for r in media.cluster_brands(df).collect()} == {(1, "A"), (1, "B")}


def test_context(spark):
    df = spark.createDataFrame([(1, 3, " b "), (1, 1, "a"), (1, 2, "b"), (1, 4, "a"), (1, 5, " "), (2, 1, None)], "v int, n int, t string")
    got = {r["v"]: r["full_semantic_payload"] for r in media.context(df, "v", "n", "t", F.lit("X"), F.lit("hi")).collect()}
    assert got == {1: "Brand: X | Speech: hi | OnScreen Text: a | b", 2: "Brand: X | Speech: hi | OnScreen Text: "}
