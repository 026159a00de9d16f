"""The driver contract, called from elsewhere: workers have no copy of the package."""

import os
import subprocess
import sys
import textwrap

import __spark_entry__ as contract

REPO = os.path.dirname(os.path.abspath(contract.__file__))


def test_contract(spark, sf):
    assert contract.entry(spark).count() == 25
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_tasks_need_no_package(tmp_path):
    code = f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry", "{REPO}/__spark_entry__.py")
        m = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(m)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "4").getOrCreate()
        for name in ("extract_records", "embed_hash", "archive_records", "knn_cosine"):
            assert m.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
        print("done")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
