"""Registered queries of the package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm import bpe, exact, langid, mixing, neardup, packing, phrases, quality, secrets, sharding, tokenfiles, toxicity, trie
from sitemill.llm.common import fold, table
from sitemill.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Largest shard in bytes of text.
SHARD_BYTES = 1 << 20
#: Shares of the mixed corpus; the other sources share the rest in proportion to their rows.
MIX_WEIGHTS, MIX_REST, MIX_SEED = {"src0": 0.2, "src1": 0.1, "src2": 0.02}, 0.68, 17

#: Links of op4: 100 * shared shingles >= this * all shingles of both.
NEAR_PERCENT = 85
#: Least frequency, longest phrase, phrases of a language, and the share of its frequency from which a longer phrase replaces one.
PHRASE_LEAST, PHRASE_WORDS, PHRASE_TOP, PHRASE_COVER = 100, 5, 2000, 100
#: Conversations take fewer than so many first turns from the first of each so many.
TRIE_HEADS, TRIE_FAMILY = 6, 100
#: Id that ends each document in token files.
END_ID = 2


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; it is not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_langid(spark, sf):
    docs = table(spark, sf, "documents")
    known = langid.learn(langid.training_rows(docs))
    return langid.classify(docs.select("doc_id", "text"), known).select(
        "doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "margin"
    )


@query
def op2_sharding(spark, sf):
    return sharding.assign(table(spark, sf, "documents"), SHARD_BYTES)


@query
def op3_exact_dedup(spark, sf):
    return exact.duplicates(table(spark, sf, "documents")).drop("row")


@query
def op4_near_dedup(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"), NEAR_PERCENT).drop("row")


@query
def op5_bpe(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", bpe.round_trip(spark, vocabulary())(F.col("text")).alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("both.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_token_files(spark, sf):
    path = scratch_path(spark, "token-files")
    tokenfiles.write(table(spark, sf, "documents"), path, vocabulary(), END_ID)
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", tokenfiles.crc32(F.col("ids")).alias("ids_crc32"))


@query
def op7_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


@query
def op8_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    net = toxicity.train(*toxicity.sample(docs, table(spark, sf, "labels")))
    return toxicity.rate(docs.select("doc_id", "text"), net).select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted")


@query
def op9_secrets(spark, sf):
    return secrets.digest(secrets.scan(table(spark, sf, "documents")))


@query
def op10_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), MIX_WEIGHTS, MIX_REST, seed=MIX_SEED).select("doc.*", "copy", "rate", "shuffle_key")


@query
def op11_packing(spark, sf):
    packed = packing.pack_texts(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), END_ID)
    return packed.select("doc_id", "start", "length", tokenfiles.crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"), PHRASE_LEAST, PHRASE_WORDS, PHRASE_TOP, PHRASE_COVER)


@query
def op13_trie(spark, sf):
    turns = trie.ordered(table(spark, sf, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TRIE_HEADS
    return trie.nodes(trie.prefixes(turns, TRIE_HEADS - 1, heads, F.col("conv_id") - F.col("conv_id") % TRIE_FAMILY))
