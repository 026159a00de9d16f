import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitemill.llm import packing
from sitemill.llm.packing import Limits

PATH = public_tokenizers.path("word_bpe_49k.json")


def held_together(rows, limits, loss=None):
    """Every id once, sequences without gaps and within all limits; the padding."""
    of_row, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0
        of_row[r.row].append(r)
        of_sequence[r.sequence_id].append(r)
    for pieces in of_row.values():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens
    padding = 0
    for pieces in of_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        total = sum(p.length for p in pieces)
        assert total <= limits.tokens and len(pieces) <= limits.segments
        if loss:
            assert sum(sum(loss[p.doc_id][p.start : p.start + p.length]) for p in pieces) <= limits.loss
        padding += 0 if total & (total - 1) == 0 else limits.tokens - total
    return {row: [i for p in pieces for i in p.ids] for row, pieces in of_row.items()}, padding


def test_texts(odd, empty):
    whole = Tokenizer.from_file(PATH)
    want = sorted([*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.collect())
    for limits in (Limits(), Limits(64, 3, 64), Limits(100, 5, 40), Limits(1, 1, 1), Limits(4096, 1, 4096)):
        got, padding = held_together(packing.pack_texts(odd, PATH, 2, limits).collect(), limits)
        assert sorted(got.values()) == want and padding == 0
    assert packing.pack_texts(empty, PATH, 2).count() == 0


def test_three_limits_on_instruction_data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3_000):
        prompt, answer = rng.randrange(0, 60), rng.choice([rng.randrange(0, 30), rng.randrange(0, 400)])
        rows.append((i, [rng.randrange(1000) for _ in range(prompt + answer)], [False] * prompt + [True] * answer))
    loss = {i: flags for i, _, flags in rows}
    ids = {i: tokens for i, tokens, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").repartition(3).withColumn("row", F.lit(7))
    for limits in (Limits(512, 16, 300), Limits(512, 4, 512), Limits(512, 64, 60), Limits(500, 16, 300, powers=False)):
        found = packing.pack_examples(df, limits).collect()
        got, padding = held_together(found, limits, loss)
        of = {r.row: r.doc_id for r in found}
        assert {of[row]: tokens for row, tokens in got.items()} == {i: t for i, t in ids.items() if t}
        sequences = len({r.sequence_id for r in found})
        # no more sequences than a tenth above what the scarcest limit asks for
        least = max(sum(map(len, ids.values())) / limits.tokens, sum(map(sum, loss.values())) / limits.loss)
        if limits.segments == 16 and not limits.powers:
            assert sequences <= 1.1 * least + 3
    odd = spark.createDataFrame([(None, [1, 2, 3], None), (1, None, None), (1, [], [True]), (1, [4, 5], [None, True, True]), (1, [4, 5], [])], "doc_id long, ids array<int>, loss array<boolean>")
    got, _ = held_together(packing.pack_examples(odd, Limits(2, 2, 1)).collect(), Limits(2, 2, 1))
    assert sorted(got.values()) == [[1, 2, 3], [4, 5], [4, 5]]


def test_the_best_agreeing_piece_is_taken():
    """The choice against its definition: of the pieces that fit, the greatest cosine with what is left."""
    rng, limits = random.Random(6), Limits(64, 8, 40)
    packer = packing.Packer(limits)
    for i in range(300):
        n = rng.randrange(1, 50)
        bears = np.array([rng.random() < 0.6 for _ in range(n)])
        for sequence in packer.add(packing.Piece(i, i, n, 0, bytes(4 * n), np.concatenate([[0], np.cumsum(bears)]))):
            assert len(sequence[0]) == limits.tokens
    while packer.pieces:
        pool = {(p.row, p.start): (len(p), 1, p.loss) for p in packer.pieces}
        left = [64, 8, 40]
        for piece in packer.fill():
            size = (len(piece), 1, piece.loss)
            fit = {k: v for k, v in pool.items() if all(a <= b for a, b in zip(v, left))}
            cosine = lambda v: sum(a * b / c / c for a, b, c in zip(v, left, (64, 8, 40))) / sum((a / c) ** 2 for a, c in zip(v, (64, 8, 40))) ** 0.5
            if fit:
                assert abs(cosine(size) - max(map(cosine, fit.values()))) < 1e-9
                pool.pop((piece.row, piece.start))
            left = [a - b for a, b in zip(left, size)]


def test_pool_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 8)
    limits, packer, most = Limits(64, 8, 64), packing.Packer(Limits(64, 8, 64)), 0
    for i in range(500):
        list(packer.add(packing.Piece(i, i, 10, 0, bytes(40), None)))
        list(packer.drain(16, 10_000))
        most = max(most, len(packer.pieces))
    assert most <= 17 and limits.tokens == 64
