"""Dictionary joins: exact keys, and needles contained in a text."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.functions.worker import once_per_worker
from sitemill.session import materialize

#: Bytes of a dictionary that are sent to every task together, and what an entry takes besides its text.
PART_BYTES, ENTRY_BYTES = 16 << 20, 64


def apply_map(
    df: DataFrame, mapping: DataFrame, column: str = "brand", key: str = "raw", value: str = "canonical"
) -> DataFrame:
    """Replace ``column`` by its mapped value; unmapped values stay, an absent column is a no-op.

    ``mapping`` has one row per key. No hint: Spark broadcasts it when it is small and
    otherwise joins by key, splitting hot keys of ``df`` (adaptive skew join).
    """
    if column not in df.columns:
        return df
    m = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(m, F.col(column) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_value", column)).drop("_key", "_value")


def first_contained(df: DataFrame, text: str, needles: DataFrame, out: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add the value of the lowest-ranked needle that the lower-cased ``text`` contains.

    ``needles`` has ``needle, value, rank`` (needles in lower case; empty ones do not count; of
    equal ranks the smaller needle). Texts are run through an Aho-Corasick automaton, once, whatever the
    number and lengths of the needles, equal texts of a batch together; rows stay where they are. A
    dictionary above ``part_bytes`` is sent in parts of about that size, each an automaton of its own.
    """
    spark = df.sparkSession
    known = needles.filter(F.length("needle") > 0).groupBy("needle").agg(F.min(F.struct("rank", "value")).alias("best"))
    known = materialize(known.select("needle", "best.rank", "best.value"), "needles")
    size = known.agg(F.sum(F.octet_length("needle") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_BYTES)).first()[0]
    if not size:
        return df.withColumn(out, F.lit(None).cast("string"))
    parts, kind = -(-size // part_bytes), known.schema["rank"].dataType
    hit = T.StructType([T.StructField("rank", kind), T.StructField("needle", T.StringType()), T.StructField("value", T.StringType())])

    def finder(part: int):
        rows = known.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part).select("rank", "needle", "value").toArrow()
        sent, key = spark.sparkContext.broadcast(rows), f"needles-{uuid.uuid4().hex}"

        def build():
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for entry in zip(*(c.to_pylist() for c in sent.value.columns), strict=True):
                automaton.add_word(entry[1], entry)
            automaton.make_automaton()
            return automaton

        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = once_per_worker(key, build)
            for texts in batches:
                coded = texts.dictionary_encode()
                best = [min((e for _, e in automaton.iter(t)), key=lambda e: e[:2], default=None) if t else None for t in coded.dictionary.to_pylist()]
                rows = [best[i] if i is not None else None for i in coded.indices.to_pylist()]
                columns = [pa.array([r[c] if r else None for r in rows], sent.value.schema.field(c).type) for c in range(3)]
                yield pa.StructArray.from_arrays(columns, ["rank", "needle", "value"], mask=pa.array([r is None for r in rows]))

        find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(find, hit)

    lower = F.lower(F.col(text))
    found = [finder(part).asNondeterministic()(lower) for part in range(parts)]
    best = found[0] if parts == 1 else F.array_min(F.array(*found))
    return df.withColumn(out, best["value"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
