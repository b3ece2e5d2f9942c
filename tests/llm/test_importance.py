"""Importance resampling against plain counting and sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from loctrack.llm import importance, queries
from tests.llm.helpers import ODD, by_id, documents, prose

COLS = ["n_features", "weight", "score", "rank"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most=2):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, most=2):
    s, t = (Counter(b for x in texts for b in features(x, most)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text, most)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        ranks.setdefault(r[0], []).append(k)
    return sorted(((r[0], r[2], r[3], r[4], ranks[r[0]].pop() if ranks.get(r[0]) and r[1] >= 20 else None) for r in rows), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_scores_and_ranks(spark):
    docs = documents(spark, [*ODD, *prose(3, 150)], repeat=[0, 7, 20, 20, 30])
    target = spark.createDataFrame([(i, t) for i, t in enumerate([*prose(3, 20), None, ""])], "item_id long, text string")
    expected = brute(pairs(docs), [r.text for r in target.collect()])
    assert by_id(importance.resample(docs, target), "id", *COLS) == expected
    assert sum(r[4] is not None for r in expected) > 20


def test_words_in_blocks_and_longer_runs(monkeypatch):
    text = " ".join(prose(9, 30)) + " É" * 50 + "x" * 300
    plain = [Counter(features(text, k)[1]) for k in (1, 2, 3)]
    monkeypatch.setattr(importance, "BLOCK", 64)
    for k in (1, 2, 3):
        blocks = list(importance.feature_blocks(text.encode(), k))
        assert len(blocks) > 5 and sum(n for n, _ in blocks) == features(text)[0]
        assert Counter(int(c) % 10_000 for _, f in blocks for c in f) == plain[k - 1]


def test_every_cutoff(spark):
    rnd = random.Random(4)
    for values in ([7] * 50, [rnd.randint(0, 5) for _ in range(60)], list(range(80)), [rnd.randint(-(10**12), 10**12) for _ in range(70)], [None, *"ba" * 20][1:]):
        rows = spark.createDataFrame([(v,) for v in values], "v string" if isinstance(values[0], str) else "v long").repartition(4)
        for k in (len(values) // 3, len(values)):
            v, below, same = importance.nth_least(rows, "v", k)
            assert (v, below, same) == (sorted(values)[k - 1], sum(x < v for x in values), values.count(v))
    with pytest.raises(ValueError):
        importance.nth_least(rows, "v", 99)


def test_rows_that_repeat_and_ties(spark):
    text = " ".join(prose(5, 5, words=30)) + " word" * 30
    docs = documents(spark, [text] * 8, repeat=[0] * 20)
    found = by_id(importance.resample(docs, docs.limit(0)), "id", "rank")
    assert sorted(r for _, r in found if r) == list(range(1, 25 * 28 // 100 + 1))
    named = docs.selectExpr("concat('n', doc_id) AS doc_id", "text").where("doc_id IS NOT NULL")
    assert sorted(r.rank for r in importance.resample(named, docs).where("rank IS NOT NULL").collect()) == list(range(1, 8))


def test_empty(spark):
    docs = documents(spark, prose(1, 3))
    assert importance.resample(docs.limit(0), docs).count() == 0
    assert {r.rank for r in importance.resample(documents(spark, ["", None]), docs.limit(0)).collect()} == {None}


def test_registered_query(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    found = queries.QUERIES["op13_importance"](spark, "/root/testdata/sf0.001")
    assert by_id(found, "doc_id", *COLS) == brute(pairs(read("documents")), [r.text for r in read("benchmark").collect()])
