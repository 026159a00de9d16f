"""Bucketed tables and batches of two tables: what is rewritten, who wins, what a retry does."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sitemill.operators import merge, store
from sitemill.sources import commits, feeds

ITEMS = "id long, company_name string, summary string, created_at string"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def files(root):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/data/*/*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    table = spark.range(1_000).select(F.col("id") + 1, F.concat(F.lit("c"), "id").alias("company_name"), F.lit("s").alias("summary"), F.lit("t1").alias("created_at")).toDF("id", "company_name", "summary", "created_at")
    assert store.create(table, root, ["company_name"], 16, "id") and not store.create(table.limit(1), root, ["company_name"], 4)
    before = files(root)
    assert len(before) == 16 and rows(store.read(spark, root)) == rows(table)
    batch = spark.createDataFrame([(0, "c5", "new"), (1, "c5", "newer"), (2, "brand", "b")], "pos long, company_name string, summary string")
    version = store.upsert(spark, root, batch, "pos", ["summary"], {"created_at": F.lit("t2")})
    after = files(root)
    assert version.number == 2 and 1 <= len(set(after) - set(before)) <= 2 and all(after[p] == t for p, t in before.items())
    want = merge.upsert(table, batch, ["company_name"], "pos", ["summary"], {"created_at": F.lit("t2")}, "id")
    assert rows(store.read(spark, root)) == rows(want) and rows(store.read(spark, root, 1)) == rows(table)
    assert store.upsert(spark, root, batch.limit(0)).number == 2 and files(root) == after
    kept = store.insert_ignore(spark, root, spark.createDataFrame([(0, 9, "c5", "x", "t3"), (1, 2_000, "other", "y", "t3")], "pos long, " + ITEMS), "pos")
    assert kept.number == 3 and rows(store.read(spark, root)) == sorted([*rows(want), (2_000, "other", "y", "t3")])
    with pytest.raises(Exception, match="null key"):
        store.upsert(spark, root, spark.createDataFrame([(0, None, "x")], "pos long, company_name string, summary string"), "pos", ["summary"])
    assert store.newest(spark, root).number == 3


def test_of_two_writers_one_starts_over(spark, tmp_path):
    root = str(tmp_path / "t")
    store.create(items(spark, (1, "A", "a", "t")), root, ["company_name"], 2, "id")
    calls = []

    def slow(current, batch, version):
        if not calls:  # the other writer is first
            store.upsert(spark, root, items(spark, (0, "B", "b", "t")), update=["summary", "created_at"])
        calls.append(version.number)
        return merge.upsert(current, batch, version.keys, None, ["summary", "created_at"], None, version.id_column, version.top)

    version = store.rewrite(spark, root, items(spark, (0, "C", "c", "t")), slow)
    assert calls == [1, 2] and version.number == 3
    assert rows(store.read(spark, root)) == [(1, "A", "a", "t"), (2, "B", "b", "t"), (3, "C", "c", "t")]
    assert len(commits.names(spark, f"{root}/versions")) == 3
    used = {p[0] for n in (1, 2, 3) for p in store.Version(**__import__("json").loads(commits.content(spark, f"{root}/versions/{n:08d}"))).parts.values()}
    assert {os.path.dirname(p) for p in files(root)} <= used  # what lost was removed
    with pytest.raises(RuntimeError):

        def always_late(current, batch, version):
            store.upsert(spark, root, items(spark, (0, "D", str(version.number), "t")), update=["summary", "created_at"])
            return current

        store.rewrite(spark, root, items(spark, (0, "E", "e", "t")), always_late, tries=2)


def test_commits_are_created_once_and_whole(spark, tmp_path):
    path = f"{tmp_path}/c/1"
    assert commits.create_once(spark, path, "one") and not commits.create_once(spark, path, "two")
    assert commits.content(spark, path) == "one" and commits.names(spark, f"{tmp_path}/c") == ["1"]
    (tmp_path / "c" / "2").write_text("half")
    assert commits.content(spark, f"{tmp_path}/c/2") is None and commits.names(spark, f"{tmp_path}/none") == []


def test_a_failure_between_two_tables_and_a_retry(spark, tmp_path):
    root = str(tmp_path)
    first, second = spark.range(5), spark.range(7)
    broken = second.select(F.raise_error(F.lit("disk")).cast("long").alias("id"))
    with pytest.raises(Exception, match="disk"):
        commits.write_batch(spark, root, "b1", {"log": first, "telemetry": broken})
    assert commits.read_batches(spark, root, "log", first.schema).count() == 0 and not glob.glob(f"{root}/log/*/*.parquet")
    assert commits.write_batch(spark, root, "b1", {"log": first, "telemetry": second})
    assert not commits.write_batch(spark, root, "b1", {"log": first, "telemetry": second})
    assert [commits.read_batches(spark, root, t, first.schema).count() for t in ("log", "telemetry", "none")] == [5, 7, 0]


def test_a_stream_of_runs_counts_each_once(spark, tmp_path):
    root, schema = str(tmp_path), "bundle_name string, status string, items_scraped int"
    for n in range(3):
        spark.createDataFrame([(f"b{n}", "SUCCESS", n)], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feeds.record_stream(stream(), f"{root}/runs", f"{root}/checkpoint", once=True).awaitTermination()
    # The last batch was stored, its commit in the checkpoint is lost: Spark repeats it.
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    feeds.record_stream(stream(), f"{root}/runs", f"{root}/checkpoint", once=True).awaitTermination()
    for table in (feeds.read_log(spark, f"{root}/runs"), feeds.read_telemetry(spark, f"{root}/runs")):
        assert sorted(r["bundle_name"] for r in table.collect()) == ["b0", "b1", "b2"] and "batch" not in table.columns
