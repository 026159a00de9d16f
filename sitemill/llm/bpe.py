"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.common import per_worker, travel

# How a byte-level vocabulary cuts a text and writes bytes as letters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

#: Pieces whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter of each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def narrow_pattern() -> str:
    """``PATTERN`` for texts without characters beyond U+00FF, in classes that the plain ``re`` module knows: three times faster."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(256)}
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(256) if kinds[c] == kind) for kind in "LN")
    blanks = "".join(re.escape(chr(c)) for c in range(256) if chr(c).isspace() and c not in range(0x1C, 0x20))
    classes = {r"[^\p{White_Space}\p{L}\p{N}]": f"[^{blanks}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]"}
    classes |= {r"\P{White_Space}": f"[^{blanks}]", r"\p{White_Space}": f"[{blanks}]"}
    found = PATTERN
    for name, own in classes.items():
        found = found.replace(name, own)
    return found


class Cutter:
    """Texts to ids, given the ids of pieces: cuts a text the way byte-level vocabularies do.

    Ids of pieces are remembered in two generations: a full one becomes the old one, which is asked
    before pieces are encoded again.
    """

    def __init__(self, added: dict[str, int], ids_of: Callable[[list[str]], list[bytes]]):
        import regex

        self.added, self.ids_of = added, ids_of
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.wide, self.narrow = regex.compile(PATTERN).findall, re.compile(narrow_pattern()).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def plain(self, text: str) -> bytes:
        pieces = self.cut(text)
        new = [p for p in set(pieces) if p not in self.young]
        if new:
            if len(self.young) + len(new) > REMEMBERED:
                self.old, self.young = self.young, {}
                new = list(set(pieces))
            self.young.update((p, self.old[p]) for p in new if p in self.old)
            new = [p for p in new if p not in self.old]
            self.young.update(zip(new, self.ids_of(new), strict=True))
        return b"".join(map(self.young.__getitem__, pieces))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. Added tokens in the text become their ids."""
        if not any(t in text for t in self.added):
            return self.plain(text)
        parts = self.apart.split(text)
        return b"".join(np.int32(self.added[p]).tobytes() if p in self.added else self.plain(p) for p in parts)


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file."""

    def __init__(self, source: str):
        import ahocorasick

        found, letters = json.loads(source), byte_letters()
        model, self.added = found["model"], {t["content"]: t["id"] for t in found["added_tokens"]}
        tokens = {bytes(letters[c] for c in name): token for name, token in model["vocab"].items() if name not in self.added}
        size = max([*tokens.values(), *self.added.values()]) + 1
        self.length, self.rank, self.split = [0] * size, [-1] * size, [(0, 0)] * size
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, token in tokens.items():
            self.length[token] = len(name)
            self.automaton.add_word(name.decode("latin-1"), (len(name), token))
        self.automaton.make_automaton()
        for rank, merge in enumerate(model["merges"]):
            left, right = (model["vocab"][x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            both = tokens[b"".join(bytes(letters[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))]
            self.pairs[left, right] = rank
            if self.rank[both] < 0:
                self.rank[both], self.split[both] = rank, (left, right)
        self.shorter = [-1] * size
        for name, token in tokens.items():
            self.shorter[token] = next((tokens[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in tokens), -1)
        spelled = dict.fromkeys(range(size), b"") | {t: n for n, t in tokens.items()} | {t: n.encode() for n, t in self.added.items()}
        self.bytes = np.frombuffer(b"".join(spelled[t] for t in range(size)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(spelled[t]) for t in range(size)])])
        self.fitting: dict[tuple[int, int], bool] = {}
        self.encode = Cutter(self.added, lambda pieces: [array("i", self.encode_piece(p.encode())).tobytes() for p in pieces])

    def fits(self, x: int, y: int) -> bool:
        """Whether merging the bytes of both tokens in rank order ends with just these two tokens."""
        # Back in time along the seam: x and y are the pieces left and right of it, each there until
        # the merge that takes it up. A merge of x and y in between would cross the seam. Of equal
        # merges the one further left comes first.
        until_x = until_y = NEVER
        while True:
            rank = self.pairs.get((x, y), NEVER)
            if rank < until_x and rank <= until_y and rank < NEVER:
                return False
            if self.rank[x] < 0 and self.rank[y] < 0:
                return True
            if self.rank[x] > self.rank[y]:
                until_x, x = self.rank[x], self.split[x][1]
            else:
                until_y, y = self.rank[y], self.split[y][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece: the longest token that fits its predecessor, else a shorter one, else one token back."""
        size = len(piece)
        longest = [0] * size
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # longer ones end later
        ids: list[int] = []
        dead = bytearray(size + 1)  # places from which no encoding leads on
        at, token, fitting, length = 0, longest[0] if size else -1, self.fitting, self.length
        if len(fitting) > REMEMBERED:
            fitting.clear()
        while at < size:
            fits = not dead[at + length[token]]
            if fits and ids:
                pair = (ids[-1], token)
                fits = fitting.get(pair)
                if fits is None:
                    fits = fitting[pair] = self.fits(*pair)
            if fits:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """Bytes gathered through the offset table; what is not UTF-8 becomes replacement characters."""
        if len(ids) == 0:
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        first = np.cumsum(sizes) - sizes
        where = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
        return self.bytes[where].tobytes().decode("utf-8", errors="replace")


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared(spark: SparkSession, path: str) -> Callable[[], Vocabulary]:
    """A function for tasks that gives the vocabulary; the file (a few MB) is read by the driver and broadcast."""
    source = file_text(path)
    sent, name = spark.sparkContext.broadcast(source), f"bpe-{len(source)}-{zlib.crc32(source.encode())}"
    return lambda: per_worker(name, lambda: Vocabulary(sent.value))


def id_lists(encoded: list[bytes]) -> pa.Array:
    sizes = np.array([len(e) // 4 for e in encoded], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def rows_of(lists: pa.Array) -> Iterator[np.ndarray]:
    """Each list of ids; a null list is empty."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for i, there in enumerate(lists.is_valid().to_pylist()):
        yield values[offsets[i] : offsets[i + 1]] if there else values[:0]


def encoder(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """Text column to ids, equal to what the vocabulary's own library gives without special tokens added.

    Null and empty texts have no ids. Texts of the vocabulary's added tokens become their ids.
    """
    vocabulary = shared(spark, path)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = vocabulary()
        for texts in batches:
            yield id_lists([table.encode(t or "") for t in texts.to_pylist()])

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, T.ArrayType(T.IntegerType())).asNondeterministic()


def decoder(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """Ids to text; a null list gives an empty text."""
    vocabulary = shared(spark, path)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = vocabulary()
        for lists in batches:
            yield pa.array([table.decode(ids) for ids in rows_of(lists)], pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, T.StringType()).asNondeterministic()


def round_trip(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """Text to ``struct<ids, decoded>``: both directions in one pass over the rows."""
    vocabulary = shared(spark, path)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = vocabulary()
        for texts in batches:
            ids = id_lists([table.encode(t or "") for t in texts.to_pylist()])
            yield pa.StructArray.from_arrays([ids, pa.array([table.decode(x) for x in rows_of(ids)], pa.string())], ["ids", "decoded"])

    both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return F.arrow_udf(both, kind).asNondeterministic()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in the column ``out`` (one of that name is replaced)."""
    return docs.withColumn(out, encoder(docs.sparkSession, path)(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids`` in the column ``out`` (one of that name is replaced)."""
    return tokens.withColumn(out, decoder(tokens.sparkSession, path)(F.col(ids)))


travel(__name__)
