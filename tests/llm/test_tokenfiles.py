import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitemill.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_files(odd, empty, tmp_path):
    library, spark = Tokenizer.from_file(PATH), odd.sparkSession
    tokenfiles.write(odd, str(tmp_path / "t"), PATH, 2, parts=5)
    rows = tokenfiles.read(spark, str(tmp_path / "t")).withColumn("crc", tokenfiles.crc32(F.col("ids"))).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    before = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (before, len(r.ids)) and r.ids[-1] == 2
        assert r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        before += r.n_tokens
    want = [[*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.collect()]
    assert sorted(r.ids for r in rows) == sorted(want)
    tokenfiles.write(empty, str(tmp_path / "e"), PATH, 2)
    assert tokenfiles.read(spark, str(tmp_path / "e")).count() == 0


def test_layout(spark, sf, tmp_path):
    tokenfiles.write(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "t"), PATH, 2, parts=2)
    for path in glob.glob(str(tmp_path / "t/*.parquet")):
        group = pq.ParquetFile(path).metadata.row_group(0)
        found = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in found["ids.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings
        assert found["doc_id"].has_column_index and found["doc_id"].has_offset_index
    few = tokenfiles.read(spark, str(tmp_path / "t")).where("doc_id between 10 and 20").select("doc_id", "start")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 11 and "GreaterThanOrEqual(doc_id,10)" in plan and "ids" not in plan
