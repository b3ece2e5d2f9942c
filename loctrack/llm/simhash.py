"""SimHash near-duplicates by vantage-point trees (operator 2).

Every distinct fingerprint is stored in one shard of a vantage-point tree and
asked in every shard that its ball overlaps; triangle bounds prune the rest of
the tree.  Distances between 64-bit fingerprints of unlike texts crowd around
32, so a ball of radius 3 over all 64 bits overlaps most shards and prunes next
to nothing.  The trees are therefore built over the two 32-bit halves: of two
fingerprints within 3 bits, one half is within 1 bit, so a ball of radius 1 in
one of the two trees finds every pair, and there only about a quarter of the
balls cross a border.  Inside a shard, a local tree goes on in the same way, and
the leaves compare all 64 bits exactly.

The upper tree is fitted on a bounded sample that grows with the shards; every
fingerprint is indexed and asked.  Shards that hold more than ``CELL_ROWS``
(dense groups of near copies) are cut into cells of stored and asking parts, so
no task gathers a group.  A cell returns spanning links, never all pairs; equal
texts share a fingerprint and meet as one row.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; rows that repeat a doc_id are each returned; a null doc_id takes part
and never names a component unless all its members are null; an empty table
gives an empty result; other columns are not read.  A very long text is held by
one task as its words; shingles are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.llm.common import keyed, slices, written
from loctrack.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints on which the upper tree is fitted: 8 for each leaf that it aims
#: at, from the first to the second number (8 MB; enough for 4e9 fingerprints).
TREE_SAMPLE, TREE_SAMPLE_MOST = 4096, 1 << 20
#: Stored fingerprints of a shard that the depth of the upper tree aims at.
SHARD_ROWS = 1 << 15
#: Rows of a side of a cell that meet in one task.
CELL_ROWS = 1 << 17
#: Stored rows of a local leaf.
LEAF = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    line, n = b" ".join(found), max(1, len(found) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    begin, end = [0, *ends[: n - 1].tolist()], (ends[size - 1 :] - 1).tolist() if len(found) >= size else [len(line)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(begin[at : at + BLOCK], end[at : at + BLOCK], strict=True)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; fp holds the 64 bits as a signed number."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return keyed(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tasks, "doc_id bigint, text_hash bigint, fp bigint")


def _half(fp: np.ndarray, half: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


class VantageTree:
    """Upper tree over 32-bit values: inner nodes are (vantage, border, near,
    far), with values at most the border in the near one; leaves are numbers."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.leaves = 0
        self.root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int):  # noqa: ANN202
        if depth:
            for vantage in sample[:3]:
                d = np.bitwise_count(sample ^ vantage)
                border = int(np.median(d))
                near = d <= border
                if 0 < near.sum() < len(sample):
                    return (vantage, border, self._grow(sample[near], depth - 1), self._grow(sample[~near], depth - 1))
        self.leaves += 1
        return self.leaves - 1

    def shards(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that the ball around a row's value overlaps."""
        rows, out = np.arange(len(values)), []

        def walk(node, rows: np.ndarray) -> None:  # noqa: ANN001
            if not len(rows):
                return
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node)))
                return
            vantage, border, near, far = node
            d = np.bitwise_count(values[rows] ^ vantage).astype(np.int16)
            walk(near, rows[d - radius <= border])
            walk(far, rows[d + radius > border])

        walk(self.root, rows)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (rows, rows)


def _leaf_links(stored: np.ndarray, asking: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Links of a leaf as rows of (u, v): those found, or if they are many, a
    star for each group that they join."""
    for at in range(0, len(asking), 4096):
        part = asking[at : at + 4096]
        near = np.bitwise_count(part[:, None] ^ stored[None, :]) <= bits
        i, j = np.nonzero(near)
        if len(i) > len(part) + len(stored):
            a, b = part.copy(), stored.copy()
            top = np.iinfo(np.uint64).max
            while True:
                a2 = np.minimum(a, np.where(near, b[None, :], top).min(1))
                b2 = np.minimum(b, np.where(near, a2[:, None], top).min(0))
                if (a2 == a).all() and (b2 == b).all():
                    break
                a, b = a2, b2
            pairs = np.concatenate([np.stack([part, a], 1), np.stack([stored, b], 1)])
        else:
            pairs = np.stack([part[i], stored[j]], 1)
        yield pairs[pairs[:, 0] != pairs[:, 1]]


def links(stored: np.ndarray, asking: np.ndarray, half: int, bits: int = MAX_BITS) -> np.ndarray:
    """Spanning links between fingerprints whose given halves lie within
    bits // 2 and the whole within bits, by a local vantage-point tree."""
    radius, out, open_ = bits // 2, [np.empty((0, 2), np.uint64)], [(stored.view(np.uint64), asking.view(np.uint64), 0)]
    while open_:
        s, a, failed = open_.pop()
        if not len(s) or not len(a):
            continue
        if len(s) <= LEAF or failed > 2:
            out.extend(_leaf_links(s, a, bits)) if len(s) <= 4096 else [out.extend(_leaf_links(s[k : k + 4096], a, bits)) for k in range(0, len(s), 4096)]
            continue
        vantage = _half(s[[(failed * len(s)) // 3]], half)[0]
        ds, da = np.bitwise_count(_half(s, half) ^ vantage).astype(np.int16), np.bitwise_count(_half(a, half) ^ vantage).astype(np.int16)
        border = int(np.median(ds))
        if (ds <= border).all():
            border -= 1
        near = ds <= border
        if not near.any():
            open_.append((s, a, failed + 1))
            continue
        open_ += [(s[near], a[da - radius <= border], 0), (s[~near], a[da + radius > border], 0)]
    return np.unique(np.concatenate(out), axis=0)


def near_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (u, v) among the distinct fingerprints of ``fps`` (fp)."""
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS))))
    size = max(TREE_SAMPLE, min(TREE_SAMPLE_MOST, 8 << depth))  # some of them for each leaf
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64)
    trees = [VantageTree(_half(sample, h), depth) for h in (0, 1)]
    radius = bits // 2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                for asks, r in ((False, 0), (True, radius)):
                    row, leaf = tree.shards(_half(fp, half), r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), half, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(np.full(len(row), asks)), pa.array(fp[row])], ["half", "leaf", "asks", "fp"])

    routed = written(fps.select("fp").mapInArrow(route, "half int, leaf int, asks boolean, fp bigint"), "routed")
    size = routed.groupBy("half", "leaf").agg(*(F.ceil(F.count(F.when(c, 1)) / CELL_ROWS).cast("int").alias(k) for k, c in (("n_stored", ~F.col("asks")), ("n_asking", F.col("asks")))))
    part = F.xxhash64(F.col("fp"), F.lit("cell"))
    cells = routed.join(size, ["half", "leaf"]).where("n_stored > 0 and n_asking > 0").select(
        "half", "leaf", "asks", "fp",
        F.when(F.col("asks"), F.pmod(part, "n_asking")).otherwise(F.pmod(part, "n_stored")).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("n_stored")).otherwise(F.col("n_asking")) - 1)).alias("other"),
    ).select("half", "leaf", "asks", "fp", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("s"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("a"))

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        fp, asks = rows.column("fp").to_numpy(), rows.column("asks").to_numpy()
        found = links(fp[~asks], fp[asks], key[0].as_py(), bits).view(np.int64)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    return cells.groupBy("half", "leaf", "s", "a").applyInArrow(cell, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of ``docs``;
    component_id is the least doc_id among the rows that a chain of links reaches,
    and root a fingerprint that tells components without ids apart."""
    prints = written(fingerprints(docs, id_col, text_col, size), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct, bits))
    joined = distinct.join(roots, distinct.fp == roots.node)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(least, "root").select("fp", "root", "component_id")
    of = distinct.join(roots, distinct.fp == roots.node, "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")).unionByName(linked)
    return prints.join(of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, the one of the least id (null
    last), then of the least text hash.  Of rows that repeat this id and text, the
    one stays whose columns have the least hash.  Rows travel packed, so other
    columns may have any names."""
    found = near_duplicates(docs, id_col, text_col, size, bits)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("key_hash"))
    rows = rows.join(kept, rows.key.eqNullSafe(kept.kept_id) & (rows.key_hash == kept.kept_hash), "left_semi")
    return rows.groupBy("key", "key_hash").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")
