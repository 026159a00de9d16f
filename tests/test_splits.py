"""Files cut anywhere give the rows of a reader that sees them whole."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from sitemill.sources import feeds, splits


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, several to a task."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def one_task(spark, path, **more):
    return spark.read.options(**feeds.CSV, multiLine=True, **more).csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quoted_csv(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    parts = ['"', '""', ",", "\n", "\r\n", "x", " ", "é", 'a"b', "long " * 30, "line\n" * 40]
    for n in range(6):
        with open(tmp_path / f"{n}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if n == 5 else "\n")
            out.writerow(["id", "a", "b"])
            out.writerows([i, "".join(rng.choice(parts) for _ in range(rng.randrange(5))), rng.choice(["", "z", "q,q"])] for i in range(80))
    for n in range(6):
        path = str(tmp_path / f"{n}.csv")
        got = splits.read_csv(spark, path, feeds.CSV)
        want = one_task(spark, path)
        if n == 5:  # the other reader takes the line ends of the file for those of the values too
            got = got.withColumn("a", F.replace("a", F.lit("\r\n"), F.lit("\n")))
        assert got.columns == ["id", "a", "b"] and rows(got) == rows(want), n
    assert splits.read_csv(spark, str(tmp_path), feeds.CSV).count() == 480
    with open(tmp_path / "5.csv", newline="") as f:
        texts = [r[1] for r in list(csv.reader(f))[1:]]
    found = splits.read_csv(spark, str(tmp_path / "5.csv"), feeds.CSV).collect()
    assert [r.a or "" for r in sorted(found, key=lambda r: int(r.id))] == texts


def test_csv_that_is_not_standard(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('id,a\n1,5" pipe\n2,"x"y,z\n\n3\n4,a,b,c\n5," ""q"" "\n6,"last\nline')
    assert rows(splits.read_csv(spark, str(tmp_path / "a.csv"), feeds.CSV)) == rows(one_task(spark, str(tmp_path / "a.csv")))
    (tmp_path / "b.csv").write_text("id,a\n")
    (tmp_path / "c.csv").write_text("")
    for name in "bc":
        assert splits.read_csv(spark, str(tmp_path / f"{name}.csv"), feeds.CSV, one_task(spark, str(tmp_path / "a.csv")).schema).count() == 0
    typed = splits.read_csv(spark, str(tmp_path / "a.csv"), feeds.CSV, spark.range(0).selectExpr("int(id) AS id", "'' AS a").schema)
    assert [r.id for r in typed.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]


def test_one_large_file_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "f.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "text"])
        out.writerows([i, f"first {i}\nsecond, {i}"] for i in range(60_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        got = feeds.read_feed(spark, str(tmp_path / "f.csv"))
        busy = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 1000").count()
        assert busy >= 5 and one_task(spark, str(tmp_path / "f.csv")).rdd.getNumPartitions() == 1
        assert got.agg(F.count("*"), F.countDistinct("id"), F.sum(F.length("text"))).first() == one_task(spark, str(tmp_path / "f.csv")).agg(F.count("*"), F.countDistinct("id"), F.sum(F.length("text"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def values(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([1, -2.5, True, None])
    if kind in (1, 2):
        return "".join(rng.choice(['"', "\\", ",", "]", "}", "[", "{", "é", "\n", "x" * 30]) for _ in range(rng.randrange(6)))
    if kind == 3:
        return {}
    if kind == 4:
        return [values(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": values(rng, depth + 1) for i in range(rng.randrange(4))}


def test_json_arrays(spark, tmp_path, small_ranges):
    rng, kept = random.Random(2), []
    for n in range(5):
        items = [{"id": 1000 * n + i, "t": "".join(rng.choice(['"', "\\", ",", "}", "]", "a"]) for _ in range(8)), "more": json.dumps(values(rng)), "deep": {"a": [[i, 2], [], [3]], "b": "x,y"}} for i in range(60)]
        (tmp_path / f"{n}.json").write_text(json.dumps(items, indent=[None, 1][n % 2], ensure_ascii=n % 2 == 0) + "\n" * n)
        kept += items
    schema = "id long, t string, more string, deep struct<a:array<array<int>>,b:string>"
    schema = spark.createDataFrame([], schema).schema
    got = splits.read_json_array(spark, str(tmp_path), schema)
    whole = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    assert got.count() == len(kept) and rows(got) == rows(whole)
    assert got.rdd.getNumPartitions() > 8
    inferred = splits.read_json_array(spark, str(tmp_path))
    assert rows(inferred.select("id", "t", "more")) == rows(whole.select("id", "t", "more"))


def test_odd_json_files(spark, tmp_path, small_ranges):
    schema = spark.createDataFrame([], "a int, b string").schema
    for text in ("[]", " [ ] \n", '[{"a": 1}]', '\n\t[\n{"a": 1, "b": "x, \\"]"} ,\n {"a": 2}\n]\n', '{"a": 1, "b": "one, object"}', "[" + ", ".join(f'{{"a": {i}}}' for i in range(200)) + "]", ""):
        path = tmp_path / "f.json"
        path.write_text(text)
        want = spark.read.schema(schema).option("multiLine", True).json(str(path))
        assert rows(splits.read_json_array(spark, str(path), schema)) == rows(want), text
