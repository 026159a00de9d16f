"""Phrase collocations by direct-address tiling.

Words are ranked by frequency and become ids, so frequent ids are near 0. Pairs of neighbouring ids
fall into square tiles: well-filled tiles are counted with a dense ``bincount`` over their cells,
sparse ones as sorted coordinates. Frequent pairs are ranked in turn and become the ids of the next
level: two overlapping phrases of k words make one of k + 1.

Texts are read once into blocks of a language's words. Blocks, not documents, are what later levels
read, so copies, long texts and hot languages cost what their words cost.
"""

from __future__ import annotations

import contextlib
import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemill.llm.common import text_of, travel
from sitemill.operators.ranking import number_rows
from sitemill.session import materialize, remove, scratch_path

# What ends a piece of text, and what parts words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"
#: Words of one block, and bytes of text that are cut into words together.
BLOCK_WORDS, CUT_BYTES = 1 << 19, 1 << 21
#: Bytes of one Arrow batch of blocks.
ARROW_BYTES = 4 << 20
#: Blocks of a Parquet row group, however well they compress; each is a page of its own.
GROUP_BLOCKS = 4
#: A tile has 2**9 ids a side; it is dense from an eighth of its cells on. Routes deal out squares of 2**5 ids a side.
TILE, SQUARE, DENSE_SHARE = 9, 5, 8
#: Blocks whose counts are merged at a time, and most routes of a level.
FAN_IN, ROUTES = 512, 1024
#: Dictionaries up to so many entries are sent to every task (about 50 MB); larger ones are joined.
SENT_WORDS, SENT_PAIRS = 400_000, 3_000_000
#: Candidates of a language are ranked in so many parts first.
SALTS = 64

_BREAK = b"\xff"  # no byte of UTF-8
_MAP = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t", bytes(range(97, 123)) + _BREAK * len(PIECE_ENDS) + b" ")


class Numbering(dict):
    """Words by order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    def __init__(self):
        self.numbers, self.codes, self.size = Numbering(), [], 0

    def add(self, texts: list[bytes]) -> None:
        words = _BREAK.join([t.translate(_MAP) for t in texts] + [b""]).replace(_BREAK, b" \xff ").split()
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)


def blocks(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``block, lang, codes, words, counts``: a language's words as numbers in the block's own list of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, Block] = {}

        def closed(name: str) -> pa.RecordBatch:
            b = open_blocks.pop(name)
            codes = np.concatenate(b.codes)
            counts = np.bincount(codes, minlength=len(b.numbers))[1:]
            words = [w.decode() for w in list(b.numbers)[1:]]
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([codes.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["lang", "codes", "words", "counts"]
            )

        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(name, []).append(t.encode())
            for name, texts in waiting.items():
                part, size = [], 0
                for t in texts:
                    part.append(t)
                    size += len(t)
                    if size >= CUT_BYTES or t is texts[-1]:
                        block = open_blocks.setdefault(name, Block())
                        block.add(part)
                        part, size = [], 0
                        if block.size >= BLOCK_WORDS:
                            yield closed(name)
                if part:
                    open_blocks.setdefault(name, Block()).add(part)
            while sum(b.size + len(b.numbers) for b in open_blocks.values()) > 3 * BLOCK_WORDS:
                yield closed(max(open_blocks, key=lambda n: open_blocks[n].size))
        for name in list(open_blocks):
            yield closed(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    found = rows.mapInArrow(cut, "lang string, codes binary, words array<string>, counts array<long>")
    return found.select(F.monotonically_increasing_id().alias("block"), "*")


def tally(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as ``left << 32 | right`` and how often they occur, tile by tile."""
    if len(left) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    side, mask = 1 << TILE, (1 << TILE) - 1
    cells = side * side
    tiles = (left >> TILE) << 32 | (right >> TILE)
    order = np.argsort(tiles, kind="stable")
    tiles, left, right = tiles[order], left[order], right[order]
    counts = None if counts is None else counts[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(tiles)) + 1, [len(tiles)]])
    dense = np.flatnonzero(np.diff(edges) >= cells // DENSE_SHARE)
    keys, sums, sparse = [], [], np.ones(len(tiles), bool)
    for i in dense:  # at most DENSE_SHARE of them per ``cells`` pairs
        a, b = edges[i], edges[i + 1]
        sparse[a:b] = False
        cell = (left[a:b] & mask) << TILE | (right[a:b] & mask)
        filled = np.bincount(cell, None if counts is None else counts[a:b], minlength=cells)  # exact below 2**53
        at = np.flatnonzero(filled)
        keys.append(((left[a] & ~mask) + (at >> TILE)) << 32 | ((right[a] & ~mask) + (at & mask)))
        sums.append(filled[at].astype(np.int64))
    rest = left[sparse] << 32 | right[sparse]
    order = np.argsort(rest, kind="stable")
    rest = rest[order]
    first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if len(rest) else np.empty(0, np.int64)
    if len(rest):
        keys.append(rest[first])
        sums.append(np.diff(np.append(first, len(rest))) if counts is None else np.add.reduceat(counts[sparse][order], first))
    return np.concatenate(keys), np.concatenate(sums).astype(np.int64)


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where an id follows another, and both ids."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at].astype(np.int64), ids[at + 1].astype(np.int64)


def short(ids: np.ndarray) -> np.ndarray:
    """Ids of which only one of consecutive -1 stays, which parts neighbours as well as many."""
    stays = np.ones(len(ids), bool)
    stays[1:] = (ids[1:] >= 0) | (ids[:-1] >= 0)
    return ids[stays]


def routed(keys: np.ndarray, counts: np.ndarray, routes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Pairs and counts by route: neighbouring pairs share one, a well-filled tile is spread over many."""
    square = (keys >> (32 + SQUARE)) * 1_000_003 + ((keys & 0xFFFFFFFF) >> SQUARE)
    route = ((square * 2654435761) >> 7) % routes
    order = np.argsort(route, kind="stable")
    keys, counts, route = keys[order], counts[order], route[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(route)) + 1, [len(route)]]) if len(route) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(route[a]), keys[a:b].tobytes(), counts[a:b].tobytes()


PARTIAL = "lang string, grp long, route long, keys binary, counts binary"


def pair_counts(ids: DataFrame, blocks: int, least: int) -> DataFrame:
    """``lang, lft, rgt, f`` of pairs of neighbouring ids that occur ``least`` times or more.

    Blocks are tallied on their own, then merged by route, ``FAN_IN`` blocks at a time; routes part
    further with every merge, so no group grows with the number of blocks.
    """
    routes, groups = max(16, min(ROUTES, blocks)), -(-blocks // FAN_IN)

    def partial(routes: int, groups: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, block, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "ids")), strict=True):
                    _, left, right = neighbours(np.frombuffer(data, np.int32))
                    rows = list(routed(*tally(left, right), routes))
                    if rows:
                        route, keys, counts = zip(*rows, strict=True)
                        group = (block * 2654435761 >> 16) % groups
                        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "grp": [group] * len(rows), "route": list(route), "keys": list(keys), "counts": list(counts)})

        return count

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("keys", "counts"))
        return tally(keys >> 32, keys & 0xFFFFFFFF, counts)

    def step(routes: int, groups: int):
        def merge(table: pa.Table) -> pa.Table:
            rows = list(routed(*merged(table), routes))
            route, keys, counts = zip(*rows, strict=True)
            lang, group = table["lang"][0].as_py(), table["grp"][0].as_py() % groups
            return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "grp": pa.array([group] * len(rows), pa.int64()), "route": pa.array(route, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

        return merge

    def last(table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        kept = counts >= least
        keys, counts = keys[kept], counts[kept]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(keys), pa.string()), "lft": keys >> 32, "rgt": keys & 0xFFFFFFFF, "f": counts})

    found = ids.select("lang", "block", "ids").mapInArrow(partial(routes, groups), PARTIAL)
    while groups > 1:
        routes, groups = routes * min(64, groups), -(-groups // FAN_IN)
        found = found.groupBy("lang", "route", "grp").applyInArrow(step(routes, groups), PARTIAL)
    return found.groupBy("lang", "route").applyInArrow(last, "lang string, lft long, rgt long, f long")


def ranked(frequent: DataFrame, ties: list[str]) -> DataFrame:
    """``id``: rank by language, then by falling frequency."""
    frequent = materialize(frequent.withColumn("minus", -F.col("f")), "phrase-counts")  # ranges are looked for and filled: two passes
    rows = number_rows(frequent, ["lang", "minus", *ties], "id", F.lit(-1)).drop("minus")
    return materialize(rows, "phrase-ranks")


def checked(known: DataFrame) -> int:
    entries = known.count()
    if entries >= 1 << 31:
        raise ValueError("more than two thousand million frequent phrases of one length: raise least")
    return entries


def word_ids(found: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """``block, lang, ids``: the blocks in ranks of ``words``; -1 for rare words and ends of pieces."""
    spark, entries = found.sparkSession, checked(words)
    small = entries <= most
    if small:
        rows = words.select("lang", "word", "id").toArrow()
        known = {}
        for name in rows["lang"].unique().to_pylist():
            own = rows.filter(pc.equal(rows["lang"], name))
            known[name] = (own["word"].combine_chunks(), own["id"].to_numpy().astype(np.int32))
        sent = spark.sparkContext.broadcast(known)
        rows = found.select("block", "lang", "codes", "words")
    else:
        each = found.select("block", "lang", F.posexplode("words").alias("pos", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
        lists = each.groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("known"))
        rows = found.select("block", "lang", "codes", F.size("words").alias("n")).join(lists, "block", "left")

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, lang, codes = (batch.column(c)[row].as_py() for c in range(3))
                if small:
                    own = batch.column(3)[row].values
                    table = np.full(len(own) + 1, -1, np.int32)
                    if lang in sent.value:
                        words, ids = sent.value[lang]
                        at = pc.fill_null(pc.index_in(own, value_set=words.cast(own.type)), -1).to_numpy()
                        table[1:] = np.where(at >= 0, ids[at], -1)
                else:
                    table = np.full(batch.column(3)[row].as_py() + 1, -1, np.int32)
                    if batch.column(4)[row].is_valid:
                        pos, ids = batch.column(4)[row].values.flatten()
                        table[pos.to_numpy() + 1] = ids.to_numpy()
                yield pa.RecordBatch.from_pydict({"block": [block], "lang": [lang], "ids": [short(table[np.frombuffer(codes, np.int32)]).tobytes()]})

    return rows.mapInArrow(translate, "block long, lang string, ids binary")


def phrase_ids(ids: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """``block, lang, ids`` of the next level: the rank of the phrase that starts at each place, -1 where it is rare."""
    spark, entries = ids.sparkSession, checked(pairs)
    small = entries <= most
    if small:
        rows = pairs.select("lft", "rgt", "id").toArrow()
        keys = rows["lft"].to_numpy() << 32 | rows["rgt"].to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], rows["id"].to_numpy()[order].astype(np.int32)))
        rows = ids.select("block", "lang", "ids")
    else:

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    _, left, right = neighbours(np.frombuffer(data, np.int32))
                    keys, _ = tally(left, right)
                    yield pa.RecordBatch.from_pydict({"block": np.full(len(keys), block), "lft": keys >> 32, "rgt": keys & 0xFFFFFFFF})

        each = ids.select("block", "ids").mapInArrow(distinct, "block long, lft long, rgt long").join(pairs.select("lft", "rgt", "id"), ["lft", "rgt"])
        lists = each.groupBy("block").agg(F.collect_list(F.struct("lft", "rgt", "id")).alias("known"))
        rows = ids.select("block", "lang", "ids").join(lists, "block", "left")

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, lang, data = (batch.column(c)[row].as_py() for c in range(3))
                before = np.frombuffer(data, np.int32)
                after = np.full(len(before), -1, np.int32)
                at, left, right = neighbours(before)
                if small:
                    keys, ranks = sent.value
                else:
                    keys = ranks = np.empty(0, np.int64)
                    if batch.column(3)[row].is_valid:
                        lft, rgt, ranks = (x.to_numpy() for x in batch.column(3)[row].values.flatten())
                        keys = lft << 32 | rgt
                        order = np.argsort(keys)
                        keys, ranks = keys[order], ranks[order]
                if len(keys):
                    wanted = left << 32 | right
                    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    after[at] = np.where(keys[where] == wanted, ranks[where], -1)
                yield pa.RecordBatch.from_pydict({"block": [block], "lang": [lang], "ids": [short(after).tobytes()]})

    return rows.mapInArrow(translate, "block long, lang string, ids binary")


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of so many bytes for jobs that run inside; the setting of before comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent_phrases(docs: DataFrame, least: int, words: int, lang: str, text: str, sent_words: int, sent_pairs: int) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of phrases up to ``words`` long that occur ``least`` times or more, and ``lang, n``: all words."""
    spark = docs.sparkSession
    found, made = written(blocks(docs, lang, text), "phrase-blocks")
    many = found.count()
    totals = materialize(found.select("lang", F.aggregate("counts", F.lit(0).cast("long"), operator.add).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    each = found.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = ranked(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), ["word"])
    level = known.select("lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"))
    levels, drop = [level], [made]
    ids, made = written(word_ids(found, known, sent_words), "phrase-ids")
    remove(spark, drop)
    for size in range(2, words + 1):
        pairs = ranked(pair_counts(ids, max(1, many), least), ["lft", "rgt"])
        left = level.select(F.col("id").alias("lft"), "phrase")
        right = level.select(F.col("id").alias("rgt"), "last")
        level = materialize(
            pairs.join(left, "lft").join(right, "rgt").select("lang", "id", "f", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last"), "phrase-level"
        )
        levels.append(level)
        drop = [made]
        if size < words:
            ids, made = written(phrase_ids(ids, pairs, sent_pairs), "phrase-ids")
        remove(spark, drop)
    every = [level.select("lang", F.lit(size).alias("size"), "phrase", "f") for size, level in enumerate(levels, 1)]
    return functools.reduce(DataFrame.unionAll, every), totals


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table of blocks written to the shared folder, and where, so that it can be removed before the end.

    Parquet sizes pages and row groups by what they hold compressed and looks at it every 100 rows only; readers
    take a row group's rows at once. Blocks of rare phrases compress to nothing, so their number is bounded.
    """
    path = scratch_path(df.sparkSession, name)
    sizes = {"parquet.page.row.count.limit": 1, "parquet.block.row.count.limit": GROUP_BLOCKS, "parquet.block.size.row.check.min": 1}
    df.write.options(compression="zstd", **sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def collocations(
    docs: DataFrame, least: int = 100, words: int = 5, top: int = 2000, cover: int = 100, lang: str = "lang", text: str = "text", sent_words: int = SENT_WORDS, sent_pairs: int = SENT_PAIRS
) -> DataFrame:
    """Per language its ``top`` phrases of 2 to ``words`` words: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's frequency (``least`` or more), ``l`` and ``r`` those of the parts at its
    weakest cut, ``n`` all words of the language and ``score`` = floor(1000 a n / (l r)). A phrase
    goes when one that is a word longer and holds it occurs at least ``cover`` percent as often
    (any longer one implies one that is a word longer).

    A null text is empty, a null language is ``und``; copies count; a language without frequent
    phrases and an empty table give no rows. Ties go to the smaller phrase in byte order.
    """
    with arrow_batches(docs.sparkSession, ARROW_BYTES):  # a row is a block, and all jobs over blocks end in here
        every, totals = frequent_phrases(docs, least, words, lang, text, sent_words, sent_pairs)
        every = materialize(every, "phrases")
    parts = F.split("phrase", " ")

    def run(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    long = every.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), parts.alias("words"))
    cuts = long.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", run(F.lit(1), F.col("cut")).alias("first"), run(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    rated = (
        cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
    )
    held = (
        long.where("size > 2")
        .select("lang", "a", F.explode(F.array(run(F.lit(1), F.col("size") - 1), run(F.lit(2), F.col("size") - 1))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = rated.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    rows = kept.select("lang", "phrase", "a", F.col("least.l").alias("l"), F.col("least.r").alias("r"), "n", F.col("least.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


travel(__name__)
