"""Packing examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing tokens.
Each task packs its own partition as a stream with a bounded pool of pieces, so nothing is shuffled
and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.bpe import id_lists, rows_of
from sitemill.llm.chunks import WordEnds, library
from sitemill.llm.common import travel

#: Pieces and tokens that a task keeps to choose from.
POOL, POOL_TOKENS = 256, 1_000_000
#: Tokens of finished sequences that are given on together.
OUT_TOKENS = 1_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``powers``: a length that is a power of two needs no padding."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    powers: bool = True


@dataclass(slots=True)
class Piece:
    """A run of one example's ids. ``borne`` counts the loss-bearing ids before each place; None when all bear loss."""

    row: int
    doc_id: object
    doc_tokens: int
    start: int
    ids: bytes
    borne: np.ndarray | None

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return len(self) if self.borne is None else int(self.borne[-1])

    def reach(self, at: int, tokens: int, loss: int) -> int:
        """The end of the longest run from ``at`` within both limits."""
        if self.borne is None:
            return min(len(self), at + min(tokens, loss))
        by_loss = int(np.searchsorted(self.borne, self.borne[at] + loss, side="right")) - 1
        return min(len(self), at + tokens, by_loss)

    def part(self, a: int, b: int) -> Piece:
        borne = None if self.borne is None else self.borne[a : b + 1] - self.borne[a]
        return Piece(self.row, self.doc_id, self.doc_tokens, self.start + a, self.ids[4 * a : 4 * b], borne)


class Packer:
    """The pool of a task. Pieces are described by vectors (tokens, segments, loss), each in shares of the limit."""

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit of a sequence must be 1 or more")
        self.limits = limits
        self.sizes = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pieces: list[Piece] = []
        self.vectors = np.zeros((2 * POOL, 3))
        self.unit = np.zeros((2 * POOL, 3))
        self.lead = np.zeros(2 * POOL)  # tokens before the first that bears loss
        self.tokens = 0

    def put(self, piece: Piece, at: int | None = None) -> None:
        if at is None:
            at = len(self.pieces)
            self.pieces.append(piece)
            if at == len(self.vectors):
                self.vectors, self.unit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.vectors, self.unit))
                self.lead = np.concatenate([self.lead, np.zeros_like(self.lead)])
        else:
            self.tokens -= len(self.pieces[at])
            self.pieces[at] = piece
        self.tokens += len(piece)
        self.vectors[at] = (len(piece), 1, piece.loss)
        share = self.vectors[at] / self.sizes
        self.unit[at] = share / np.sqrt(share @ share)
        self.lead[at] = piece.reach(0, len(piece), 0)

    def take(self, at: int) -> Piece:
        piece, last = self.pieces[at], len(self.pieces) - 1
        self.tokens -= len(piece)
        for x in (self.vectors, self.unit, self.lead):
            x[at] = x[last]
        self.pieces[at] = self.pieces[last]
        self.pieces.pop()
        return piece

    def add(self, example: Piece) -> Iterator[list[Piece]]:
        """Whole sequences of a long example at once; the rest joins the pool."""
        at, full = 0, self.limits.tokens
        while at < len(example):
            end = example.reach(at, full, self.limits.loss)
            piece = example.part(at, end)
            if len(piece) == full:
                yield [piece]
            else:
                self.put(piece)
            at = end

    def fill(self) -> list[Piece]:
        """One sequence: the piece whose direction agrees best with what is left, as long as any fits; then one is cut to fill up."""
        left, chosen = self.sizes.copy(), []
        while self.pieces and left[0] >= 1 and left[1] >= 1:
            n = len(self.pieces)
            agree = self.unit[:n] @ (left / self.sizes)
            fits = (self.vectors[:n] <= left).all(axis=1)
            if fits.any():
                piece = self.take(int(np.argmax(np.where(fits, agree, -1.0))))
            else:
                can = np.ones(n, bool) if left[2] >= 1 else self.lead[:n] >= 1
                if not can.any():
                    break
                at = int(np.argmax(np.where(can, agree, -1.0)))
                whole = self.pieces[at]
                end = whole.reach(0, int(left[0]), int(left[2]))
                piece = whole.part(0, end)
                self.put(whole.part(end, len(whole)), at)
            left -= (len(piece), 1, piece.loss)
            chosen.append(piece)
        return chosen

    def exact(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """A sequence with room left as sequences whose lengths are powers of two."""
        total = sum(map(len, pieces))
        if not self.limits.powers or total == self.limits.tokens or total & (total - 1) == 0:
            yield pieces
            return
        rest = list(reversed(pieces))
        for bit in reversed(range(total.bit_length())):
            room, part = total & (1 << bit), []
            while room:
                piece = rest.pop()
                if len(piece) > room:
                    rest.append(piece.part(room, len(piece)))
                    piece = piece.part(0, room)
                room -= len(piece)
                part.append(piece)
            if part:
                yield part

    def drain(self, pool: int, tokens: int) -> Iterator[list[Piece]]:
        """Sequences until no more than so many pieces and tokens are left to choose from."""
        while len(self.pieces) > pool or self.tokens > tokens:
            yield from self.exact(self.fill())


def _packed(rows: DataFrame, kind: T.DataType, examples: Callable[[pa.RecordBatch], Iterator[tuple[bytes, np.ndarray | None]]], limits: Limits) -> DataFrame:
    """``rows`` start with ``row`` and ``doc_id``; ``examples`` gives the ids of a batch's rows and which of them bear loss."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits), TaskContext.get().partitionId() << 32
        ready: list[tuple] = []
        held = 0
        types = None

        def sequences() -> Iterator[list[Piece]]:
            nonlocal types
            for batch in batches:
                types = batch.schema.field(1).type
                for row, doc_id, (ids, bears) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), examples(batch), strict=True):
                    borne = None if bears is None else np.concatenate([[0], np.cumsum(bears)])
                    yield from packer.add(Piece(row, doc_id, len(ids) // 4, 0, ids, borne))
                    yield from packer.drain(2 * POOL, POOL_TOKENS)
                yield from packer.drain(POOL, POOL_TOKENS)
            yield from packer.drain(0, 0)

        def rows_ready() -> pa.RecordBatch:
            row, doc_id, start, doc_tokens, sequence, offset, ids = zip(*ready, strict=True)
            sizes = [len(x) // 4 for x in ids]
            columns = [pa.array(x, pa.int64()) for x in (row, start, sizes, doc_tokens, sequence, offset)]
            return pa.RecordBatch.from_arrays([columns[0], pa.array(doc_id, types), *columns[1:], id_lists(list(ids))], ["row", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for pieces in sequences():
            offset = 0
            for p in pieces:
                ready.append((p.row, p.doc_id, p.start, p.doc_tokens, number, offset, p.ids))
                offset += len(p)
            number += 1
            held += offset
            if held >= OUT_TOKENS:
                yield rows_ready()
                ready, held = [], 0
        if ready:
            yield rows_ready()

    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    fields = [T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in longs], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(pack, T.StructType(fields))


def pack_texts(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as ids of ``vocabulary``, each with ``end_id`` appended, packed; every id bears loss.

    One row per piece: ``row`` (number of the document's row), ``doc_id``, ``start`` (its document's
    ids before it), ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence)
    and ``ids``. A null or empty text has only the end id; null and repeated ids are rows of
    their own; an empty table gives no rows. Other columns are not read. A task's pieces depend on
    the order of its rows only, so a lost one comes out the same again.
    """
    encoder = library(docs.sparkSession, vocabulary, WordEnds)
    end = np.array([end_id], "<i4").tobytes()

    def examples(batch: pa.RecordBatch) -> Iterator[tuple[bytes, None]]:
        encode = encoder()
        for t in batch.column(2).to_pylist():
            yield encode(t or "") + end, None

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _packed(rows, rows.schema["doc_id"].dataType, examples, limits)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", ids: str = "ids", loss: str = "loss") -> DataFrame:
    """Examples with ids and a flag per id that says whether it bears loss (instruction data: the answers), packed.

    The result is that of ``pack_texts``. A null list of flags means that all ids bear loss, a null flag that its id
    does not; missing flags count as null, surplus ones are not read. Null or empty ids give no piece.
    """

    def of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray | None]]:
        for tokens, flags in zip(rows_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            bears = None
            if flags is not None:
                bears = np.zeros(len(tokens), np.int64)
                known = flags[: len(tokens)]
                bears[: len(known)] = [bool(f) for f in known]
            yield tokens.astype("<i4").tobytes(), bears

    rows = examples.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"), F.col(loss).cast("array<boolean>").alias("loss")
    )
    return _packed(rows, rows.schema["doc_id"].dataType, of, limits)


travel(__name__)
