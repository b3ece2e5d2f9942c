"""Conversation prefix trie by minimal-perfect-hash node tables (operator 11).

A node is a distinct sequence of first turns, told by a 128-bit digest: the
exclusive or of a hash of each turn with its depth, so that the digests of a
long conversation are made by blocks of turns that different tasks hold.

Blocks of conversations are dealt to shards of a bounded number of rows.  A
shard enumerates its distinct digests, gives each a slot by a minimal perfect
hash (every look-up is verified against the digests stored in the slots) and
scatters members into flat arrays.  A sum over the shards gives the members of
each node and its least one, which owns the node: exactly one shard holds the
owner's turn.  In a second pass each shard puts the values of the nodes that it
owns into their slots and adds them up through the array of parent slots, from
the deepest on.  A node's total is the sum of its totals in all shards, as every
node below it counts once, in its owner's shard; what an owner has in later
blocks enters at the last turn of each earlier block.

Neither a hot conversation (cut into blocks), nor a hot first turn (one row for
each shard), nor many copies of one conversation are held by one task.  Only the
SHA-256 over a node's ids is sequential by definition: texts of joined ids are
made in parallel, and one task passes over them, holding one at a time.

Defined cases: rows without conv_id belong to no conversation; null role or text
is empty; turns of equal number (or none) follow by a hash of role and text; rows
that repeat are turns of their own; a conversation without turns ends at the
root; an empty table has no node; other columns are not read.  Texts of any
length are only hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loctrack.llm.common import written

#: Turns of a conversation in one block.
BLOCK = 4096
#: Rows of a shard on average; one hash value of the deal holds 5 blocks at most.
SHARD_ROWS = 1 << 16
#: Ids that are joined to one text.
IDS = 4096


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys: on each level, keys alone at
    their place of a bitmap are settled, and the rank of the set bits is the slot."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        left, settled = np.arange(len(a)), 0
        while len(left):
            at = self._place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            slots = settled + np.cumsum(alone) - 1
            self.levels.append((alone, slots))
            here = alone[at]
            mine = slots[at[here]]
            self.a[mine], self.b[mine] = a[left[here]], b[left[here]]
            left, settled = left[~here], settled + int(alone.sum())

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.full(len(a), (level + 1) * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that the slots do not hold."""
        out, open_ = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, slots) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(a[open_], b[open_], level, len(alone))
            hit = alone[at]
            slot, row = slots[at[hit]], open_[hit]
            same = (self.a[slot] == a[row]) & (self.b[slot] == b[row])
            out[row[same]] = slot[same]
            open_ = open_[~hit]
        return out


def _u64(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().view(np.uint64)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return new


def turn_places(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, h1, h2, bytes) of every turn, pos from 0 by turn (null
    first).  A conversation may lie in many tasks: rows are sorted by ranges, and
    what earlier ranges hold of it is added."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("row")).where("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("row")]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            start = np.flatnonzero(_runs(conv))
            size = np.diff([*start, len(conv)])
            at = np.arange(len(conv)) - np.repeat(start, size)
            if last == conv[0]:
                at[: size[0]] += count
            last, count = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "h1", "h2", "bytes", F.spark_partition_id().alias("part"))
    local = written(ordered.mapInArrow(places, "conv_id bigint, h1 bigint, h2 bigint, bytes bigint, part int, at bigint"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = local.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier)).where("before is not null").drop("n")
    # at most one conversation goes on into a range: a row for each range at most
    return local.join(F.broadcast(held), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "bytes")


def rebuilt(places: DataFrame, group: int = 5, heads: int = 9, block: int = BLOCK) -> DataFrame:
    """(conv_id, d, h1, h2, bytes, length): every conversation c with the first h
    turns of conversation c - c % ``group`` before its own turns after the first
    h, where h = crc32(c) % ``heads``; d from 1.  A row of depth 0 stands for the
    conversation itself."""
    first = places.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "bytes"))).alias("turns")).withColumnRenamed("conv_id", "base")
    convs = places.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    plan = convs.join(first, "base", "left").withColumn("turns", F.slice(F.coalesce("turns", F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))).withColumn("lead", F.size("turns").cast("bigint"))
    plan = written(plan.select("conv_id", "h", "lead", "n", "turns", (F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "rebuilding")
    roots = plan.select("conv_id", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"), F.lit(0).cast("bigint").alias("bytes"), "length")
    lead = plan.select("conv_id", "length", F.posexplode("turns").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("bigint").alias("d"), "t.h1", "t.h2", "t.bytes", "length")
    # joined by blocks, so that a hot conversation is many keys
    cells = plan.select("conv_id", "h", "lead", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("cell"))
    own = places.withColumn("cell", F.floor(F.col("pos") / block)).join(cells, ["conv_id", "cell"]).where("pos >= h").select("conv_id", (F.col("lead") + F.col("pos") - F.col("h") + 1).alias("d"), "h1", "h2", "bytes", "length")
    return roots.unionByName(lead).unionByName(own)


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, blk, d, a1, a2, p1, p2, bytes, last): the digest of the first d
    turns and that of its parent; blk counts blocks of depths.  Inside a block a
    running exclusive or, and one row that brings that of all earlier blocks."""
    rows = rows.select("conv_id", F.when(F.col("d") > 0, F.floor((F.col("d") - 1) / block)).otherwise(0).cast("bigint").alias("blk"), "d", F.when(F.col("d") > 0, F.xxhash64("d", "h1", "h2")).otherwise(0).alias("k1"), F.when(F.col("d") > 0, F.xxhash64("h2", F.lit(1), "h1", "d")).otherwise(0).alias("k2"), "bytes", (F.col("d") == F.col("length")).alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "blk").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    carried = totals.select("conv_id", "blk", F.lit(-1).cast("bigint").alias("d"), *(F.bit_xor(k).over(earlier).alias(k) for k in ("k1", "k2")), F.lit(0).cast("bigint").alias("bytes"), F.lit(False).alias("last")).where("blk > 0")
    cells = rows.unionByName(carried).repartition("conv_id", "blk").sortWithinPartitions("conv_id", "blk", "d")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, (np.uint64(0), np.uint64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, blk, d = (batch.column(k).to_numpy() for k in range(3))
            new = _runs(conv, blk)
            if last == (conv[0], blk[0]):
                new[0] = False
            start = np.flatnonzero(new)
            run = np.cumsum(new)  # 0: goes on from the batch before
            out = []
            for k in (0, 1):
                own = batch.column(3 + k).to_numpy().view(np.uint64)
                whole = np.bitwise_xor.accumulate(own)
                before = np.concatenate([held[k : k + 1], np.where(start > 0, whole[start - 1], np.uint64(0))]).astype(np.uint64)
                digest = whole ^ before[run]
                out += [digest, digest ^ own]
            last, held = (conv[-1], blk[-1]), (out[0][-1], out[2][-1])
            keep = pa.array(d >= 0)
            cols = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(out[k].view(np.int64)) for k in (0, 2, 1, 3)), batch.column(5), batch.column(6)]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "blk", "d", "a1", "a2", "p1", "p2", "bytes", "last"]).filter(keep)

    return cells.mapInArrow(running, "conv_id bigint, blk bigint, d bigint, a1 bigint, a2 bigint, p1 bigint, p2 bigint, bytes bigint, last boolean")


def _members(key: tuple, rows: pa.Table) -> pa.Table:
    """The distinct digests of a shard with members, ends and least member; a
    node that the shard only needs as a parent has none."""
    a, b = _u64(rows, "a1"), _u64(rows, "a2")
    order = np.lexsort((b, a))
    first = order[_runs(a[order], b[order])]
    table = SlotTable(a[first], b[first])
    slot, n = table.slots(a, b), len(first)
    counted = ~rows.column("ghost").to_numpy()
    at = np.empty(n, np.int64)
    at[slot[first]] = first
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot[counted], rows.column("conv_id").to_numpy()[counted])
    return pa.table({"shard": pa.array(np.full(n, key[0].as_py(), np.int64)), **{c: rows.column(c).take(pa.array(at)) for c in ("a1", "a2", "p1", "p2", "d", "bytes")}, "n": np.bincount(slot[counted], minlength=n), "ends": np.bincount(slot[counted & rows.column("last").to_numpy()], minlength=n), "least": least})


def _totals(block: int, rows: pa.Table) -> pa.Table:
    """A shard's share of each node's children, leaves and saved bytes; with the
    members, depth and parent's least member of the nodes that it owns.  Sums stop
    at the first turn of a block; rows of depth -1 bring what comes from later ones."""
    value = pc.equal(rows.column("d"), -1).to_numpy()
    late, rows = rows.filter(pa.array(value)), rows.filter(pa.array(~value))
    table = SlotTable(_u64(rows, "a1"), _u64(rows, "a2"))
    n = rows.num_rows
    order = np.empty(n, np.int64)
    order[table.slots(_u64(rows, "a1"), _u64(rows, "a2"))] = np.arange(n)
    rows = rows.take(pa.array(order))  # row k is slot k
    depth, members, ends, least, rep = (rows.column(c).to_numpy() for c in ("d", "n", "ends", "least", "rep"))
    parent = np.where(depth > 0, table.slots(_u64(rows, "p1"), _u64(rows, "p2")), -1)
    owned = least == rep
    leaves = (owned & (members == ends)).astype(np.int64)
    saved = np.where(owned, (members - 1) * rows.column("bytes").to_numpy(), 0)
    if late.num_rows:
        at = table.slots(_u64(late, "a1"), _u64(late, "a2"))
        np.add.at(leaves, at, late.column("n").to_numpy())
        np.add.at(saved, at, late.column("bytes").to_numpy())
    children = np.bincount(parent[owned & (parent >= 0)], minlength=n)
    deep = np.argsort(-depth, kind="stable")
    for level in np.split(deep, np.flatnonzero(np.diff(depth[deep])) + 1):
        up = level[(parent[level] >= 0) & ((depth[level] == 1) | ((depth[level] - 1) % block != 0))]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    up = pa.array(rep[parent], mask=~owned | (parent < 0))
    own = lambda x: pa.array(x, mask=~owned)
    return pa.table({"a1": rows.column("a1"), "a2": rows.column("a2"), "n_children": children, "n_leaves": leaves, "saved": saved, "conv_id": own(rep), "depth": own(depth), "n_convs": own(members), "parent_conv_id": up})


def ends_digests(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """(a1, a2, sha): SHA-256 of the ids (conv_id) of each node, ascending and
    comma-joined.  Ranges of ids are joined to texts, which the hash passes over."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a1, a2, conv = (batch.column(k).to_numpy() for k in range(3))
            start = sorted({*np.flatnonzero(_runs(a1, a2)).tolist(), *range(0, len(conv), ids)})
            texts = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(start, [*start[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a1[start]), pa.array(a2[start]), pa.array(conv[start]), pa.array(texts)], ["a1", "a2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for a1, a2, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if node != (a1, a2):
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a1, a2), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("a1", "a2", "sha"), r, strict=True)) for r in out], schema)
            out.clear()
        if node:
            yield pa.RecordBatch.from_pylist([{"a1": node[0], "a2": node[1], "sha": sha.hexdigest()}], schema)

    schema = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("sha", pa.string())])
    texts = ends.select("a1", "a2", "conv_id").repartitionByRange("a1", "a2", "conv_id").sortWithinPartitions("a1", "a2", "conv_id").mapInArrow(joined, "a1 bigint, a2 bigint, first bigint, ids string")
    return texts.repartition("a1", "a2").sortWithinPartitions("a1", "a2", "first").mapInArrow(hashed, "a1 bigint, a2 bigint, sha string")


def prefix_trie(turns: DataFrame, rebuild: Callable[[DataFrame], DataFrame] = rebuilt, block: int = BLOCK, shard_rows: int = SHARD_ROWS, group: int = 5) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved,
    ends_sha256) of every node.  ``rebuild`` takes the placed turns (``turn_places``)
    and gives the rows of ``rebuilt``."""
    rows = written(prefixes(rebuild(written(turn_places(turns), "places")), block), "prefixes")
    shards = max(1, -(-rows.count() // shard_rows))
    home = lambda blk: F.pmod(F.xxhash64(F.floor(F.col("conv_id") / group), blk), F.lit(shards))
    # the last turn of a block, for the block after it
    bridge = (F.col("d") > 0) & (F.col("d") % block == 0) & ~F.col("last")
    placed = rows.withColumn("ghost", F.lit(False)).unionByName(rows.where(bridge).withColumn("blk", F.col("blk") + 1).withColumn("ghost", F.lit(True))).withColumn("shard", home(F.col("blk")))
    local = written(placed.groupBy("shard").applyInArrow(_members, "shard bigint, a1 bigint, a2 bigint, p1 bigint, p2 bigint, d bigint, bytes bigint, n bigint, ends bigint, least bigint"), "shards")
    nodes = local.groupBy("a1", "a2").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("least").alias("rep"))
    known = written(local.drop("n", "ends").join(nodes, ["a1", "a2"]), "nodes")
    # values of an owner in later blocks, at the last turn of each block
    own = known.where((F.col("least") == F.col("rep")) & (F.col("d") > block)).select(F.col("rep").alias("conv_id"), F.floor((F.col("d") - 1) / block).alias("blk"), (F.col("n") == F.col("ends")).cast("bigint").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.col("blk").desc())
    bridges = rows.where(bridge).select("conv_id", (F.col("blk") + 1).alias("blk"), "a1", "a2")
    sums = own.groupBy("conv_id", "blk").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    late = bridges.join(sums, ["conv_id", "blk"], "left").select("conv_id", "blk", "a1", "a2", *(F.sum(F.coalesce(c, F.lit(0))).over(later).alias(c) for c in ("leaves", "saved")))
    zero, none = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    late = late.select(home(F.col("blk") - 1).alias("shard"), "a1", "a2", zero.alias("p1"), zero.alias("p2"), none.alias("d"), F.col("saved").alias("bytes"), F.col("leaves").alias("n"), zero.alias("ends"), zero.alias("least"), zero.alias("rep"))
    parts = known.unionByName(late).groupBy("shard").applyInArrow(lambda rows: _totals(block, rows), "a1 bigint, a2 bigint, n_children bigint, n_leaves bigint, saved bigint, conv_id bigint, depth bigint, n_convs bigint, parent_conv_id bigint")
    whole = parts.groupBy("a1", "a2").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")), *(F.max(c).alias(c) for c in ("conv_id", "depth", "n_convs", "parent_conv_id")))
    sha = F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))
    return whole.join(ends_digests(rows.where("last")), ["a1", "a2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", sha.alias("ends_sha256"))
