import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitemill.llm import bpe, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "᠎", "​", "'s", "'T", "'ll", "9", "１", "é", "²", "ª", "日", "🙂", "<|endoftext|>", "<|endof", "!", "_", " the", "\r\n", "\x00", "́", "﻿", "==", "aaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(bpe.file_text(PATH))


def test_like_the_library(library, own):
    rng, by_pieces = random.Random(2), tokenfiles.library_encoder(bpe.file_text(PATH))
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(4_000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60))) for _ in range(1_000)] + ["a" * n for n in range(1, 70)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<i4").tolist() == want, text
        assert np.frombuffer(by_pieces(text), "<i4").tolist() == want, text
        assert own.decode(np.array(want, int)) == library.decode(want, skip_special_tokens=False)


def test_decode_any_ids(library, own):
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(30)]
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_take_linear_time(own):
    rng = random.Random(4)
    for text in ("a" * 300_000, "".join(rng.choice("abcdefghij") for _ in range(100_000))):
        assert own.decode(np.frombuffer(own.encode(text), "<i4")) == text


def test_memory_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.Vocabulary(bpe.file_text(PATH))
    for text in ("a b c d e f g h i j k", "k j i a b", "l m n o p a", "a b c d e f g h i j k"):
        assert small.encode(text) == own.encode(text) and len(small.encode.young) <= 15


def test_columns(odd, empty, library):
    both = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert set(both.columns) == {*odd.columns, "decoded"}
    for r in both.select("text", "ids", "decoded").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    once = odd.select("text", bpe.round_trip(odd.sparkSession, PATH)(F.col("text")).alias("b")).select("text", "b.*")
    assert once.where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).isEmpty()
    assert bpe.decode(empty.select(F.lit(None).cast("array<int>").alias("ids")), PATH).count() == 0
    assert bpe.decode(odd.limit(1).select(F.lit(None).cast("array<int>").alias("ids")), PATH).first().decoded == ""
