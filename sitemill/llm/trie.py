"""Conversation prefix trie, screened by a count-min sketch.

A prefix is known by a digest of 128 bits: the exclusive or of a hash of each of its turns and their
places, so digests of a conversation that lies in several partitions are put together from parts.
A prefix whose count is estimated as one belongs to one conversation; so do all that follow it, and
their nodes are written where they are. Only prefixes that may be shared are grouped exactly.

Texts are read once, to hash them; no later step moves them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.llm.common import attach, travel
from sitemill.session import materialize

#: Counters of each of the sketch's two rows: this many per prefix, between these powers of two. What is broadcast is a bit per counter, 16 MB at most.
PER_PREFIX, LEAST_BITS, MOST_BITS = 8, 16, 26
#: Counters that are merged together.
CHUNK = 1 << 16


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, idx`` (from 1), hashes ``c1, c2`` of role and text, code points ``size``, and ``run``, written.

    Turns go by ``turn`` (null first), equal ones by role and the MD5 of the text; null role and
    text are empty. Rows without a conversation id belong to none and are left out. Rows are
    dealt out by conversation and turn, so a conversation of any length lies in as many runs as it needs.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), F.md5(t).alias("tie"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(r, t).alias("c1"), F.xxhash64(F.lit(1), t, r).alias("c2"), F.length(t).cast("long").alias("size"),
    )
    order = ["conv_id", "turn", "role", "tie", "row"]
    dealt = materialize(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("run")), "turns")
    inside = Window.partitionBy("run", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "tie", "row")
    placed = dealt.withColumn("idx", F.row_number().over(inside).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("run", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("run", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return placed.join(shift, ["run", "conv_id"]).select("conv_id", (F.col("idx") + F.col("shift")).alias("idx"), "c1", "c2", "size", "run")


def running(rows: DataFrame, values: dict[str, Column], fold: Callable[[Column], Column], add: Callable[[Column, Column], Column], back: bool = False) -> DataFrame:
    """``rows`` with running totals of ``values`` in a conversation, by depth (``back``: from its end).

    Totals run inside a conversation's part in one run; the totals of the runs before it, a row
    per run, are added.
    """
    at, run = (F.desc("d"), F.desc("run")) if back else (F.asc("d"), F.asc("run"))
    inside = Window.partitionBy("run", "conv_id").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("run", "conv_id").agg(*[fold(v).alias(f"_{k}") for k, v in values.items()])
    carry = sums.select("run", "conv_id", *[F.coalesce(fold(F.col(f"_{k}")).over(before), F.lit(0)).alias(f"_{k}") for k in values])
    found = rows.select("*", *[fold(v).over(inside).alias(k) for k, v in values.items()]).join(carry, ["run", "conv_id"])
    return found.withColumns({k: add(F.col(k), F.col(f"_{k}")) for k in values}).drop(*[f"_{k}" for k in values])


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def hashes(place: Column, c1: Column, c2: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, c1, c2), F.xxhash64(F.lit(2), place, c2, c1)


def prefixes(turns: DataFrame, most: int = 0, heads: Column | None = None, donor: Column | None = None) -> DataFrame:
    """A row per prefix of each conversation, the empty one included, from ``ordered`` turns, written.

    ``conv_id, d`` (turns), ``x1, x2`` (digest), ``p1, p2`` (the digest without the last turn),
    ``size`` of the last turn, ``end`` (it is the whole conversation) and ``run``.

    With ``heads`` (a number of turns from 0 to ``most``) and ``donor`` (an id), both expressions of
    ``conv_id``, the first turns of a conversation are those of its donor (all it has if fewer,
    none if there is no donor), and its own follow without its first ``heads``.
    """
    heads, donor = heads if heads is not None else F.lit(0), donor if donor is not None else F.lit(None).cast("long")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", heads.cast("long").alias("h"), donor.cast("long").alias("donor"))
    first = turns.where(F.col("idx") <= most).groupBy(F.col("conv_id").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("idx", "c1", "c2", "size"))).alias("given"))
    given = F.slice(F.coalesce("given", F.array().cast("array<struct<idx:bigint,c1:bigint,c2:bigint,size:bigint>>")), F.lit(1), F.col("h").cast("int"))
    facts = own.join(first, "donor", "left").select("conv_id", "h", "n", given.alias("given")).withColumn("kept", F.size("given").cast("long"))
    facts = facts.withColumn("whole", F.col("kept") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    facts = materialize(facts.select("*", (-1 - F.spark_partition_id()).alias("run")), "trie-heads")

    def step(nodes: Column, t: Column) -> Column:
        last = F.element_at(nodes, -1)
        z1, z2 = hashes(t["idx"], t["c1"], t["c2"])
        node = F.struct(t["idx"].alias("d"), xor(last["x1"], z1).alias("x1"), xor(last["x2"], z2).alias("x2"), last["x1"].alias("p1"), last["x2"].alias("p2"), t["size"].alias("size"))
        return F.concat(nodes, F.array(node))

    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("d"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("size"))
    nodes = facts.select("conv_id", "whole", "run", F.aggregate("given", F.array(root), step).alias("nodes"))
    front = nodes.select("conv_id", "run", "whole", F.explode("nodes").alias("t")).select("conv_id", "t.*", (F.col("t.d") == F.col("whole")).alias("end"), "run")
    # The last digest of the head starts the digests of what follows it.
    starts = nodes.select("conv_id", F.element_at("nodes", -1)["x1"].alias("s1"), F.element_at("nodes", -1)["x2"].alias("s2"))
    rest = attach(turns, ["conv_id"], facts.select("conv_id", "h", "kept", "whole").join(starts, "conv_id")).where("idx > h")
    z1, z2 = hashes(F.col("d"), F.col("c1"), F.col("c2"))
    rest = rest.withColumn("d", F.col("idx") - F.col("h") + F.col("kept")).withColumns({"z1": z1, "z2": z2})
    rest = running(rest, {"x1": F.col("z1"), "x2": F.col("z2")}, F.bit_xor, xor).withColumns({"x1": xor(F.col("x1"), F.col("s1")), "x2": xor(F.col("x2"), F.col("s2"))})
    tail = rest.select("conv_id", "d", "x1", "x2", xor(F.col("x1"), F.col("z1")).alias("p1"), xor(F.col("x2"), F.col("z2")).alias("p2"), "size", (F.col("d") == F.col("whole")).alias("end"), "run")
    return materialize(front.unionByName(tail), "trie-prefixes")


def singles(found: DataFrame, rows: int) -> Callable[[Column, Column], Column]:
    """A function of two digest columns: whether the sketch proves that one conversation has the prefix.

    The sketch's counters stop at two. Tasks count what they read and give on the places of their
    counters, chunk by chunk; a bit per counter says whether it stands at one. A prefix is alone
    when any of its counters stands at one, as its estimate is the least of them.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (PER_PREFIX * rows).bit_length()))
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((2, width), np.uint8)
        for batch in batches:
            for row in range(2):
                cells, n = np.unique(batch.column(row).to_numpy() & (width - 1), return_counts=True)
                counters[row, cells] = np.minimum(counters[row, cells] + np.minimum(n, 2), 2)
        for row in range(2):
            for chunk in np.flatnonzero(counters[row].reshape(-1, CHUNK).any(axis=1)):
                part = counters[row, chunk * CHUNK : (chunk + 1) * CHUNK]
                once, more = (np.flatnonzero(part == n).astype(np.uint16).tobytes() for n in (1, 2))
                yield pa.RecordBatch.from_pydict({"row": [row], "chunk": [int(chunk)], "once": [once], "more": [more]})

    def merge(table: pa.Table) -> pa.Table:
        counters = np.zeros(CHUNK, np.int64)
        for once, more in zip(table["once"].to_pylist(), table["more"].to_pylist(), strict=True):
            counters[np.frombuffer(once, np.uint16)] += 1
            counters[np.frombuffer(more, np.uint16)] += 2
        return pa.table({"row": table["row"][:1], "chunk": table["chunk"][:1], "alone": pa.array([np.packbits(counters == 1).tobytes()], pa.binary())})

    partial = found.where("d > 0").select("x1", "x2").mapInArrow(count, "row long, chunk long, once binary, more binary")
    alone = np.zeros((2, width // CHUNK, CHUNK // 8), np.uint8)
    for r in partial.groupBy("row", "chunk").applyInArrow(merge, "row long, chunk long, alone binary").toLocalIterator():
        alone[r["row"], r["chunk"]] = np.frombuffer(r["alone"], np.uint8)
    sent = found.sparkSession.sparkContext.broadcast(alone.reshape(2, -1))

    def single(x1: pa.Array, x2: pa.Array) -> pa.Array:
        known = np.zeros(len(x1), bool)
        for row, x in enumerate((x1, x2)):
            cell = x.fill_null(0).to_numpy(zero_copy_only=False) & (width - 1)
            known |= (sent.value[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(known)

    single.__annotations__ = {"x1": pa.Array, "x2": pa.Array, "return": pa.Array}
    return F.arrow_udf(single, T.BooleanType())


def ends(shared: DataFrame) -> DataFrame:
    """``x1, x2, ends_sha256``: the conversations that end at each prefix, by id, comma-joined and hashed.

    Ids are joined range by range first; a prefix at which very many end is a row per range,
    read as a stream.
    """
    dealt = materialize(shared.where("end").select("x1", "x2", "conv_id").repartitionByRange("conv_id").select("*", F.spark_partition_id().alias("part")), "trie-ends")
    lists = dealt.groupBy("x1", "x2", "part").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (x1, x2) != at:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (x1, x2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["x1", "x2", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, state.hexdigest())], ["x1", "x2", "ends_sha256"])

    order = lists.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "part")
    return order.select("x1", "x2", "ids").mapInArrow(digest, "x1 long, x2 long, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(found: DataFrame) -> DataFrame:
    """A row per distinct prefix of ``prefixes``; see ``COLUMNS``.

    ``conv_id`` is the smallest of the conversations that start with it (``n_convs``),
    ``parent_conv_id`` that of its parent (null for the root), ``n_leaves`` the childless nodes
    and ``saved_tokens`` the code points that sharing saves in its subtree, itself included, and
    ``ends_sha256`` tells which conversations it is the whole of. No turns give no node.

    Sums over subtrees need no walk: every leaf, and every node's saving, is given to its smallest
    conversation, and a node sums up what its conversations were given from its depth on.
    """
    alone = singles(found, found.count())
    flags = {"single": (F.col("d") > 0) & alone(F.col("x1"), F.col("x2")), "parent_single": (F.col("d") > 1) & alone(F.col("p1"), F.col("p2"))}
    rows = materialize(found.withColumns(flags), "trie-screened")
    shared, own = rows.where("not single"), rows.where("single")
    groups = shared.groupBy("x1", "x2", "d").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("size").alias("size"), F.first("parent_single").alias("parent_single")
    )
    groups = materialize(groups, "trie-groups")
    children = groups.where("d > 0 and not parent_single").select("p1", "p2").unionAll(own.where("not parent_single").select("p1", "p2")).groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    groups = materialize(groups.join(children, ["x1", "x2"], "left").fillna(0, ["n_children"]).select("*", F.spark_partition_id().alias("run")), "trie-nodes")

    known = attach(shared.select("run", "conv_id", "d", "x1", "x2", "end"), ["x1", "x2"], groups.select("x1", "x2", "owner", "n", "n_children", "size"))
    mine = F.col("owner") == F.col("conv_id")
    gains = known.select("run", "conv_id", "d", "x1", "x2", F.when(mine, (F.col("n") - 1) * F.col("size")).otherwise(0).alias("gain"), (mine & F.col("end") & (F.col("n_children") == 0)).cast("long").alias("leaf"))
    # A conversation whose last node is its own is a leaf of all nodes before it.
    last = own.where("end").select("run", "conv_id", "d", F.lit(None).cast("long").alias("x1"), F.lit(None).cast("long").alias("x2"), F.lit(0).cast("long").alias("gain"), F.lit(1).cast("long").alias("leaf"))
    given = running(gains.unionByName(last), {"saved": F.col("gain"), "leaves": F.col("leaf")}, F.sum, lambda a, b: a + b, back=True)
    sums = given.where("x1 is not null").groupBy("x1", "x2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = groups.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("owner").alias("parent"))
    up = attach(groups.where("d > 0 and not parent_single"), ["p1", "p2"], parents).select("x1", "x2", "parent")
    nothing = F.sha2(F.lit(""), 256)
    first = (
        groups.join(sums, ["x1", "x2"])
        .join(up, ["x1", "x2"], "left")
        .join(ends(shared), ["x1", "x2"], "left")
        .select(
            F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("parent_single"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )

    def alone_nodes(rows: DataFrame, parent: Column) -> DataFrame:
        whole = F.when(F.col("end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        return rows.select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("end"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), whole.alias("ends_sha256"))

    tails = alone_nodes(own.where("parent_single"), F.col("conv_id"))
    tops = alone_nodes(attach(own.where("not parent_single"), ["p1", "p2"], parents), F.col("parent"))
    return first.unionByName(tails).unionByName(tops).select(*COLUMNS)


travel(__name__)
