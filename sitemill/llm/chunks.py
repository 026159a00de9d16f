"""Ids from the tokenizers library, chunk by chunk: texts are cut where no token can reach across, and chunks met before are looked up.

A worker asks the library's model for new pieces only; whole texts are never sent to it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from sitemill.llm.bpe import PATTERN, byte_letters, file_text, narrow_pattern
from sitemill.llm.common import per_worker, travel

# Fixed value: how a vocabulary with word ends cuts a text in lower case; white space is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: White space that Unicode counts as such; Python counts four separators more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
MORE_WHITE = re.compile("[\x1c-\x1f]").search
MARKS = frozenset(",.;:!?")
#: Chunks and pieces that are remembered. Pieces come back more often and cost more to work out.
CHUNKS, PIECES = 500_000, 700_000
#: A full memory starts anew after it lacked so many times what it holds.
AGAIN = 8


class Remembered(dict):
    """A mapping that works out what it does not hold. A full one takes in no more, until what it lacks shows that it holds the wrong things."""

    def __init__(self, work_out: Callable[[str], bytes], most: int):
        super().__init__()
        self.work_out, self.most, self.lacked, self.full, self.old = work_out, most, 0, False, {}

    def __missing__(self, key: str) -> bytes:
        found = self.work_out(key)
        if self.full:
            self.lacked += 1
        else:
            self[key] = found
        return found

    def trim(self) -> None:
        if self.lacked > AGAIN * self.most:
            self.clear()
            self.lacked = 0
        self.full = len(self) >= self.most


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LibraryEncoder:
    """Texts to ids (little-endian 32-bit integers), as the library gives without special tokens added, truncation and padding."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t.content: np.int32(i).tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        self.apart = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.letters = {b: c for c, b in byte_letters().items()}
        self.model = self.library.model
        self.pieces = Remembered(self.ids_of_piece, PIECES)
        self.chunks = Remembered(self.ids_of_chunk, CHUNKS)

    def ids_of_piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def ids_of_chunk(self, chunk: str) -> bytes:
        raise NotImplementedError

    def ids_of_text(self, text: str) -> bytes:
        raise NotImplementedError

    def __call__(self, text: str) -> bytes:
        self.pieces.trim()
        self.chunks.trim()
        if any(t in text for t in self.added):
            return b"".join(self.added[p] if p in self.added else self.ids_of_text(p) for p in self.apart.split(text))
        return self.ids_of_text(text)


class ByteLevel(LibraryEncoder):
    """Vocabularies of byte letters. A text parts before every space that stands before something else than white space."""

    unclear = re.compile(r" (?:\s|\Z)").search
    apart_at = re.compile(f" (?=[^{WHITE}])")

    def __init__(self, source: str):
        import regex

        super().__init__(source)
        self.wide, self.narrow = regex.compile(PATTERN).findall, re.compile(narrow_pattern()).findall

    def cut(self, text: str) -> bytes:
        find = self.narrow if latin(text) else self.wide
        return b"".join(map(self.pieces.__getitem__, find(text)))

    def ids_of_chunk(self, chunk: str) -> bytes:
        if latin(chunk):  # most chunks are a word, or a word and one mark
            if chunk.isalpha():
                return self.pieces[" " + chunk]
            if chunk[:-1].isalpha() and chunk[-1] in MARKS:
                return self.pieces[" " + chunk[:-1]] + self.pieces[chunk[-1]]
        return self.cut(" " + chunk)

    def ids_of_text(self, text: str) -> bytes:
        first, *rest = self.apart_at.split(text) if self.unclear(text) else text.split(" ")
        return self.cut(first) + b"".join(map(self.chunks.__getitem__, rest))


class WordEnds(LibraryEncoder):
    """Vocabularies of lower-case words with word ends. White space parts a text and is dropped."""

    apart_at = re.compile(f"[{WHITE}]+")

    def __init__(self, source: str):
        super().__init__(source)
        kinds = {c: unicodedata.category(chr(c))[0] for c in range(256)}
        letters, numbers = ("".join(re.escape(chr(c)) for c in range(256) if kinds[c] == kind) for kind in "LN")
        blanks = "".join(re.escape(chr(c)) for c in range(256) if chr(c).isspace() and c not in range(0x1C, 0x20))
        own = WORD_PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
        self.narrow = re.compile(own.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall

    def ids_of_chunk(self, chunk: str) -> bytes:
        if not latin(chunk):  # characters that compose or have special lower cases
            return array("i", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        if chunk.isalpha():
            return self.pieces[chunk.lower()]
        if chunk[:-1].isalpha() and chunk[-1] in MARKS:
            return self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.narrow(chunk.lower())))

    def ids_of_text(self, text: str) -> bytes:
        words = [w for w in self.apart_at.split(text) if w] if MORE_WHITE(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, words))


def library(spark: SparkSession, path: str, kind: type[LibraryEncoder] = ByteLevel) -> Callable[[], LibraryEncoder]:
    """A function for tasks that gives the encoder; the vocabulary file (a few MB) is read by the driver and broadcast."""
    source = file_text(path)
    sent, name = spark.sparkContext.broadcast(source), f"library-{kind.__name__}-{len(source)}-{zlib.crc32(source.encode())}"

    def build() -> LibraryEncoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        return kind(sent.value)

    return lambda: per_worker(name, build)


travel(__name__)
