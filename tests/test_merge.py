"""Keyed merges, versions, snapshots and numbering."""

import pytest
from pyspark.sql import functions as F

from sitemill.operators import merge, ranking, vectors
from sitemill.plans import report, snapshot

ITEMS = "id long, company_name string, summary string, source_url string, created_at string"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "pos int, company_name string, summary string, source_url string")


@pytest.fixture(params=["10MB", "-1"])
def threshold(spark, request):
    """Both merge plans: a broadcast batch and a shuffled one."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_upsert(spark, threshold):
    current = items(spark, (1, "A", "a", "ua", "t1"), (2, "B", "b", "ub", "t1"))
    new = batch(spark, (0, "B", "b1", "u1"), (1, "C", "c1", "u1"), (2, "B", None, "u2"), (3, "D", "d", "u"))
    out = merge.upsert(current, new, ["company_name"], "pos", ["summary", "source_url"], {"created_at": F.lit("t2")}, "id")
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "A", "a", "ua", "t1"),
        (2, "B", None, "u2", "t1"),
        (3, "C", "c1", "u1", "t2"),
        (4, "D", "d", "u", "t2"),
    ]
    again = merge.upsert(out, new, ["company_name"], "pos", ["summary", "source_url"], {"created_at": F.lit("t3")}, "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_null_keys_are_rejected(spark):
    with pytest.raises(Exception, match="null key"):
        merge.upsert(items(spark, (1, "A", "a", "u", "t")), batch(spark, (0, None, "x", "u")), ["company_name"], "pos", ["summary"]).collect()


def test_insert_ignore(spark, threshold):
    current = items(spark, (1, "A", "a", "u", "t"))
    new = items(spark, (5, "A", "x", "x", "x"), (6, "B", "first", "u", "t"), (7, "B", "second", "u", "t"))
    out = merge.insert_ignore(current, new, ["company_name"], "id")
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, "A", "a"), (6, "B", "first")]


def test_broadcast_merge_does_not_shuffle_the_table(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("v").alias("v")).write.parquet(str(tmp_path / "t"))
    current = spark.read.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("1", "w")], "k string, v string").write.parquet(str(tmp_path / "b"))
    new = spark.read.parquet(str(tmp_path / "b"))
    plan = merge.upsert(current, new, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("pos"))
    out = merge.dedupe_last(df, ["k"], "pos")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("k = -1").first()["pos"] == 9999 and out.count() == 6667


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ranking.number_rows(df, ["k"], "n", F.lit(10)).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 11) for i in range(1000)]


def test_versions_and_gate(spark, tmp_path):
    root = str(tmp_path / "t")
    merge.write_version(items(spark, (1, "A", "a", "u", "t")), root, 1)
    current = merge.read_version(spark, root)
    merge.write_version(merge.upsert(current, batch(spark, (0, "B", "b", "u")), ["company_name"], "pos", ["summary"]), root, 2)
    assert merge.read_version(spark, root).count() == 2 and current.count() == 1
    merge.load_gate(2, 2)
    for counts in ((0, 0), (2, 1)):
        with pytest.raises(RuntimeError):
            merge.load_gate(*counts)


def test_collection(spark, tmp_path):
    root = str(tmp_path / "c")
    vectors.create_collection(spark, root, 2, "Manhattan")
    assert vectors.collection_meta(spark, root) == (2, "Cosine")
    points = spark.createDataFrame([(1, [1.0, 0.0], {"name": "Acme"}), (2, [0.0, 1.0], None)], vectors.POINTS)
    assert vectors.upsert_points(spark, root, points) == 2
    assert vectors.upsert_points(spark, root, points.limit(0)) == 2
    vectors.upsert_points(spark, root, spark.createDataFrame([(2, [0.6, 0.8])], "id bigint, vector array<float>"))
    stored = {r["id"]: r for r in vectors.read_points(spark, root).collect()}
    assert stored[1]["payload"] == {"name": "Acme"} and stored[2]["payload"] == {} and stored[2]["vector"][0] > 0.5
    bad = spark.createDataFrame([(3, [1.0], {})], vectors.POINTS)
    with pytest.raises(Exception, match="expected 2 dimensions"):
        vectors.upsert_points(spark, root, bad)
    vectors.create_collection(spark, root, 9, "Dot")
    assert vectors.collection_meta(spark, root) == (2, "Cosine")


def test_snapshot_and_restore(spark, tmp_path):
    root = str(tmp_path / "s")
    broken = spark.range(3).select(F.raise_error(F.lit("disk")).cast("long").alias("x"))
    manifest = snapshot.write({"a": spark.range(5), "b": spark.range(0), "c": broken}, root)
    assert {r["component"]: (r["row_count"], r["status"]) for r in manifest.collect()} == {
        "a": (5, "ok"), "b": (0, "empty"), "c": (0, "failed"),
    }
    assert snapshot.snapshot_status(manifest).first()["status"] == "partial"
    restored = snapshot.restore(spark, root, ["a", "b", "c", "d"], str(tmp_path / "r"))
    assert {r["component"]: r["status"] for r in restored.collect()} == {"a": "ok", "b": "empty", "c": "skipped", "d": "skipped"}
    assert spark.read.parquet(str(tmp_path / "r" / "a")).count() == 5


@pytest.mark.parametrize(
    ("statuses", "snap", "rest"),
    [
        (["ok", "ok"], "complete", "complete"),
        (["empty", "empty"], "partial", "failed"),
        (["ok", "failed"], "partial", "partial"),
        (["failed"], "failed", "failed"),
        (["ok", "skipped"], "partial", "complete"),
        (["partial", "failed"], "failed", "partial"),
        (["empty", "skipped"], "partial", "failed"),
    ],
)
def test_status_roll_ups(spark, statuses, snap, rest):
    df = spark.createDataFrame([(s, 1) for s in statuses], "status string, row_count long")
    assert snapshot.snapshot_status(df).first()["status"] == snap
    assert snapshot.restore_status(df).first()["status"] == rest


def joined(page):
    rows = sorted(page.collect())
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return "\n".join(r["html"] for r in rows)


def test_batch_that_looks_small_is_not_broadcast(spark):
    """A batch made large by an explode: its real size decides, not the estimate."""
    current = spark.range(200_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    grown = spark.createDataFrame([(0,), (100_000,)], "s long").select(F.explode(F.sequence("s", F.col("s") + 199_999)).alias("k"))
    batch = grown.select("k", F.sha2(F.col("k").cast("string"), 512).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        out = merge.upsert(current, batch.dropDuplicates(["k"]), ["k"])
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 300_000 and out.where("v = 'old'").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report(spark):
    rows = items(spark, (1, "<A>", None, None, "2024-01-01"), (2, "B & C", "s", "https://x/?a=1&b", "2024-01-02"))
    html = joined(report.page(rows.withColumn("created_at", F.to_timestamp("created_at"))))
    assert html.index("B &amp; C") < html.index("&lt;A&gt;") and 'href="#"' in html and "2 row(s)" in html
    none = joined(report.page(rows.limit(0).withColumn("created_at", F.to_timestamp("created_at"))))
    assert "No rows yet" in none and "0 row(s)" in none
