import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitemill.llm import chunks

WHITES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
PARTS = ["a", "Foo", "ÉTÉ", "ß", "Σ", "ΑΣ", "İ", "é", "́", "ǅ", "1", "23", "²", "½", "ª", "'s", "'LL", "don't", ",", ".", "!!", "-", "_", "<|endoftext|>", "<|startoftext|>", "<|end", "🙂", "中文", "क्षि", "\x00", "\x7f", "\xad", "​", "﻿", *WHITES, " ", " ", " ", "  ", "\n\n", " \n", "\n "]


@pytest.mark.parametrize(("kind", "name"), [(chunks.ByteLevel, "byte_bpe_50k.json"), (chunks.WordEnds, "word_bpe_49k.json")])
def test_same_as_the_library_on_whole_texts(kind, name, sf, spark):
    path = public_tokenizers.path(name)
    whole, rng = Tokenizer.from_file(path), random.Random(5)
    whole.no_truncation()
    whole.no_padding()
    encode = kind(open(path, encoding="utf-8").read())
    texts = ["", " ", "  a", "a ", "a \n b", "\t \nb", *["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(6_000)]]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    for text in texts:
        assert np.frombuffer(encode(text), "<i4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_what_is_remembered_is_bounded():
    asked = []
    seen = chunks.Remembered(lambda key: asked.append(key) or key.encode(), 10)
    for round in range(3):
        for key in "abcdefgh":
            seen.trim()
            assert seen[key] == key.encode()
    assert asked == list("abcdefgh")
    for i in range(100):
        seen.trim()
        assert seen[str(i)] == str(i).encode() and len(seen) <= 11 and len(seen.old) <= 11


def test_what_is_remembered_first_stays_until_too_much_is_lacking():
    asked = []
    seen = chunks.Remembered(lambda key: asked.append(key) or key.encode(), 10)
    common = "abcdefghij"
    for i in range(10 * chunks.AGAIN):
        seen.trim()
        assert [seen[c] for c in common] == [c.encode() for c in common] and seen[str(i)] == str(i).encode()
    assert all(asked.count(c) == 1 for c in common)
    for i in range(20):
        seen.trim()
        assert seen["new"] == b"new"
    assert asked.count("new") < 20 and len(seen) <= 11
