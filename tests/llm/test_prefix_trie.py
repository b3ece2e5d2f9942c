"""Prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
from loctrack.llm import prefix_trie, queries
from tests.llm.helpers import by_id

TURNS = "conv_id long, turn long, role string, text string, pos long, d string, a1 int, blk string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
        ends[turns].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in sorted(nodes, key=len, reverse=True):
        if n:
            saved[n] += (len(nodes[n]) - 1) * len(n[-1][1].encode())
            children[n[:-1]] += 1
        leaves[n] += not children[n]
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in nodes.items()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS).repartition(5)


def check(spark, rows, block=4096, shard_rows=1 << 16):
    found = prefix_trie.prefix_trie(frame(spark, rows), partial(prefix_trie.rebuilt, block=block), block, shard_rows)
    assert by_id(found, *COLS) == brute(rows)


def conversations(seed, n, longest=12, texts=3):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b" * 40, "é漢"][:texts])) for c in rnd.sample(range(3 * n), n) for t in range(rnd.randint(1, longest))]


def test_small_shards_and_blocks(spark):
    check(spark, conversations(2, 60), block=3, shard_rows=20)
    check(spark, conversations(3, 40, texts=1), block=2, shard_rows=10)


def test_one_deep_conversation_and_copies_of_its_beginning(spark):
    long = [(7, t, "user", f"t{t}") for t in range(300)]
    copies = [(c, t, "user", f"t{t}") for c in (3, 8, 21, 40) for t in range(60 + c)]
    check(spark, long + copies, block=16, shard_rows=64)


def test_hot_first_turn_and_exact_copies(spark):
    rows = [(c, t, "user", "same" if t == 0 or c % 2 else f"{c} {t}") for c in range(200) for t in range(4)]
    check(spark, rows, shard_rows=50)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, None, None), (6, 0, "", ""), (11, 2, "user", "x" * 100_000), (11, 10, "user", "\x00é"), (2, 0, "a", "bc"), (3, 0, "ab", "c"), (-4, 0, "u", "v")]
    check(spark, [r for r in rows if r[0] != -4], block=2)
    found = prefix_trie.prefix_trie(frame(spark, rows))
    assert found.agg({"n_convs": "max"}).first()[0] == 6
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0


def test_slots_are_minimal_and_verified():
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 50, 3000).astype(np.uint64), np.arange(3000, dtype=np.uint64)
    table = prefix_trie.SlotTable(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(3000))
    assert (table.slots(a, b + np.uint64(3000)) == -1).all()


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.001")
    assert by_id(found.withColumnRenamed("saved_tokens", "saved"), *COLS) == brute(rows)
    assert {t for _, t in found.drop("ends_sha256").dtypes} == {"bigint"}
