"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.common import BLANKS, attach, numbered, text_of
from sitemill.session import materialize

KEY = ["digest", "check"]


def squeezed(text):
    """The text without blanks."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def digest_runs(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its run, SHA-256 of the squeezed text, an independent check of it, and its rank.

    ``first`` orders copies: most code points of the original text, then smallest id (null last), then row.
    """
    whole = text_of(text)
    return rows.withColumn("squeezed", squeezed(whole)).select(
        "row",
        "run",
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2("squeezed", 256)).alias("digest"),
        F.xxhash64(F.length("squeezed"), "squeezed").alias("check"),
        F.struct((-F.length(whole)).alias("shorter"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col("row").alias("row")).alias("first"),
    )


def merge_tree(leaves: DataFrame, fan: int = 16) -> DataFrame:
    """Smallest ``first`` and number of ``copies`` per digest, merged over a tree of runs.

    A run is what one partition holds. Round k merges ``fan`` neighbouring runs: each sends its
    rows in digest order, one per digest, and a digest keeps its smallest row. A digest shared by
    a third of all rows is one row per run after the first level. Digests meet only with equal
    check values, so different texts with one digest would stay apart.
    """
    runs = leaves.agg(F.max("run")).first()[0]
    best = [F.min("first").alias("first"), F.sum("copies").alias("copies")]
    merged = leaves.withColumn("copies", F.lit(1).cast("long")).groupBy("run", *KEY).agg(*best)
    width = (runs or 0) + 1
    while width > 1:
        merged = merged.groupBy(F.floor(F.col("run") / fan).cast("int").alias("run"), *KEY).agg(*best)
        width = -(-width // fan)
    return merged.select(*KEY, F.col("first"), F.col("copies"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = 16) -> DataFrame:
    """Per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256, row``.

    Texts are equal when they are identical without blanks; null counts as empty, so all null and
    blank texts are one group. Of a group the longest original text stays, then the smallest id; a
    null id is last. Rows that repeat an id and text are one document written twice: one of them is
    kept. An empty table gives no rows. Other columns are not read.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _decide(digest_runs(narrow), fan)


def _decide(runs: DataFrame, fan: int) -> DataFrame:
    leaves = materialize(runs.sortWithinPartitions(*KEY), "digest-runs")
    groups = merge_tree(leaves, fan).select(*KEY, F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "copies")
    return attach(leaves.select("row", "run", "doc_id", *KEY), KEY, groups).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = 16) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = numbered(docs, "exact-docs")
    narrow = rows.select("row", "run", F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"))
    kept = _decide(digest_runs(narrow), fan).where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
