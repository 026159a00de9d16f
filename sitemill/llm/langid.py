"""Language identification by compression: the language whose dictionary packs a text smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.common import fold, per_worker, travel

#: Text per language in its dictionary: this many pieces of so many characters, from distinct texts.
PIECES, PIECE_CHARS = 200, 400
#: Characters that are packed at once: short, so that a text's own repetition does not hide the dictionary.
BLOCK = 1_500
UNKNOWN = "und"
ADDED = ["lang_pred", "score", "margin", "accepted"]
#: Bits of difference between the two smallest encodings that count as one unit of evidence.
BITS_PER_UNIT = 16.0


@dataclass(frozen=True)
class Dictionaries:
    """Language names, most frequent first, and the raw content of their dictionaries."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", pieces: int = PIECES, chars: int = PIECE_CHARS, seed: int = 1) -> Dictionaries:
    """Dictionaries from a bounded sample of labelled rows: ``pieces`` texts per language, ``chars`` of each.

    Texts are chosen by a hash of the text, so copies count once. Rows without text or language,
    and languages whose texts are all empty, teach nothing.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(F.trim(F.col(text))) > 0)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    mark = F.xxhash64(F.lit(seed), F.col("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Dictionaries((), ())
    # A share of each language that gives some times the pieces, then the smallest hashes of those.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 8.0 * pieces / n)))])
    few = rows.where((F.pmod(mark, F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("text")), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    cut = few.select("lang", mark.alias("mark"), F.lower(F.substring(F.col("text"), start.cast("int"), F.lit(chars))).alias("piece")).distinct()
    best = cut.groupBy("lang").agg(F.expr(f"slice(array_sort(collect_list(struct(mark, piece))), 1, {pieces})").alias("best")).collect()
    found = {r["lang"]: " ".join(x["piece"] for x in r["best"]).encode() for r in best}
    names = sorted(found, key=lambda k: (-counts[k], k))
    return Dictionaries(tuple(names), tuple(found[k] for k in names))


class Packer:
    """Packed sizes of a text under every dictionary."""

    def __init__(self, known: Dictionaries, level: int = 7):
        import zstandard

        self.packers = []
        for content in known.contents:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                level, window_log=20, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, strategy=zstandard.STRATEGY_BTLAZY2
            )
            data.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress)

    def sizes(self, text: str) -> np.ndarray:
        """Bytes under each dictionary, summed over the blocks of the whole text."""
        folded = text.lower()
        blocks = [folded[i : i + BLOCK].encode() for i in range(0, len(folded), BLOCK)]
        return np.array([sum(len(pack(b)) for b in blocks) for pack in self.packers], float)


def decide(sizes: np.ndarray) -> tuple[int, float, float]:
    """The smallest (the first of equals), its share of the evidence, and its relative margin over the next."""
    order = np.argsort(sizes, kind="stable")
    odds = np.exp2(-(sizes - sizes[order[0]]) * 8 / BITS_PER_UNIT)
    margin = float((sizes[order[1]] - sizes[order[0]]) / sizes[order[0]]) if len(sizes) > 1 else 1.0
    return int(order[0]), float(1 / odds.sum()), margin


def prediction(known: Dictionaries, docs: DataFrame, margin: float):
    """Column function: text to ``struct<lang_pred, score, margin, accepted>``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # pieces * chars per language
    name = f"langid-{zlib.crc32(repr(known).encode())}"

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, packer = sent.value.names, per_worker(name, lambda: Packer(sent.value))
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                if not t or not names or not any(map(str.isalpha, t)):
                    out.append((UNKNOWN, 0.0, 0.0, False))
                else:
                    best, score, gap = decide(packer.sizes(t))
                    out.append((names[best], score, gap, gap >= margin))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ADDED)

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.StructType([T.StructField(c, k) for c, k in zip(ADDED, [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()], strict=True)])
    return F.arrow_udf(predict, kind).asNondeterministic()


def classify(docs: DataFrame, known: Dictionaries, text: str = "text", margin: float = 0.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted`` (columns of these names are replaced).

    A text that is null or has no letter is ``und`` with score 0 and not accepted; so is every text
    when no language was learned. Others get the language with the smallest encoding and are
    accepted when the next one is larger by a share of at least ``margin``; of equal encodings the
    language with more labelled rows wins. Rows are judged one by one, by their text only. An empty
    table gives no rows.
    """
    given = docs.select(F.struct("*").alias("doc"), prediction(known, docs, margin)(F.col(text).cast("string")).alias("found"))
    return given.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED], *[F.col(f"found.{c}").alias(c) for c in ADDED])


def keep_known(docs: DataFrame, known: Dictionaries, text: str = "text", margin: float = 0.0) -> DataFrame:
    """The documents that ``classify`` accepts, with their own columns only."""
    given = docs.select(F.struct("*").alias("doc"), prediction(known, docs, margin)(F.col(text).cast("string")).alias("found"))
    return given.where("found.accepted").select("doc.*")


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that are not held out."""
    return docs.where(fold(doc_id) != 2)


travel(__name__)
