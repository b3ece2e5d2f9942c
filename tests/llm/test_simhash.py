import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import ODD, by_id, documents, prose

from loctrack.llm import simhash as S
from loctrack.llm.components import components


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_spark_hash(spark):
    from pyspark.sql import functions as F

    texts = [*ODD, *prose(3, 40), "one two", "A b C d"]
    for t in texts:
        assert S.fingerprint(t) == brute_print(t), t
    got = spark.createDataFrame([("über a b",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("über a b", 42)


@pytest.mark.parametrize("small", [True, False])
def test_components_of_texts(spark, monkeypatch, small):
    if small:
        for name, n in (("SHARD_ROWS", 8), ("CELL_ROWS", 4), ("LEAF", 2)):
            monkeypatch.setattr(S, name, n)
    rnd, base = random.Random(5), prose(4, 30, words=200)
    near = []
    for t in base[:10]:
        for _ in range(6):
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    texts = [*base, *near, *base[:5], *ODD]
    docs = documents(spark, texts, repeat=[0, 1])
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    group = brute_components([fp for _, fp in rows])
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None) if any(h == g and r[0] is not None for r, h in zip(rows, group, strict=True)) else None for g in set(group)}
    want = sorted(((d, fp, least[g]) for (d, fp), g in zip(rows, group, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted({x for _, _, x in want if x is not None})


def test_links_of_dense_and_sparse_fingerprints():
    rnd = np.random.default_rng(1)
    centre = rnd.integers(0, 1 << 63, 8, dtype=np.uint64)
    flips = lambda n: np.bitwise_xor.reduce(np.uint64(1) << rnd.integers(0, 64, (n, 2), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 400, dtype=np.uint64), *(c ^ flips(200) for c in centre)]))
    want = brute_components(fps.tolist())
    pairs = np.concatenate([S.links(fps.view(np.int64), fps.view(np.int64), h) for h in (0, 1)])
    at = {int(x): i for i, x in enumerate(fps.tolist())}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs.tolist():
        root[find(at[a])] = find(at[b])
    assert len({(find(i), g) for i, g in enumerate(want)}) == len(set(want)) == len({find(i) for i in range(len(fps))})
    assert len(pairs) < 40 * len(fps)


def test_empty_and_null(spark):
    docs = documents(spark, [])
    assert by_id(S.near_duplicates(docs), "doc_id", "component_id") == [(None, None)]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_row_of_each_component_by_row(spark):
    """Rows without ids and rows that share an id, of which some are near copies."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(400)) for k in "abcd")
    near = lambda t: t + " " + t.split()[-1]
    prints = [brute_print(t) for t in (a, b, c, d, near(a), near(b), near(c))]
    assert len(set(brute_components(prints))) == 4
    docs = spark.createDataFrame([(None, a), (None, near(a)), (None, b), (1, near(b)), (7, c), (7, near(c)), (7, d), (7, d), (None, "short")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in S.keep_one_of_each(docs).collect()]
    assert len(kept) == 5
    assert (1, near(b)) in kept and (7, d) in kept and (None, "short") in kept
    assert len({(None, a), (None, near(a))} & set(kept)) == 1 and len({(7, c), (7, near(c))} & set(kept)) == 1
