import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from helpers import LABELS, ODD, by_id, documents, prose

from loctrack.llm import conv_quality as C
from loctrack.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def sample():
    clean = prose(7, 60, words=300)
    junk = [t.replace(" ", "*** ") for t in prose(8, 20, words=300)]
    return clean, junk


def test_base_counts_and_ratio(spark):
    clean, junk = sample()
    texts = [*clean, *junk, *ODD, "x\nx\n \n \ny\nx", "a b c a b c a b c d"]
    docs = documents(spark, texts, repeat=[0])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(3, 1, 0), (62, 0, 0), (None, 1, 0)], LABELS)
    rows = {(r.doc_id, r.n_words): r for r in Q.assess(docs, labels).collect()}
    raw, trusted = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for r in docs.collect():
        np.add.at(raw, Q.buckets(r.text), 1)
        if r.doc_id is not None and r.doc_id < 40:
            np.add.at(trusted, Q.buckets(r.text), 1)
    p, weight = (raw + 1) / (raw + 1).sum(), 1 + Q.SMOOTHING * trusted.sum()
    log = np.log((trusted + weight * p) / (trusted.sum() + weight) / p)
    for d in docs.collect():
        want = brute(d.text)
        r = rows[d.doc_id, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.ratio == pytest.approx(log[Q.buckets(d.text)].mean() if d.text else 0, abs=1e-9)
        assert r.kept == (not r.base_failed and r.ratio >= Q.THRESHOLD)
    assert all(rows[i, len(t.split())].kept for i, t in enumerate(clean) if len(t.split()) >= 50)
    assert not any(rows[60 + i, len(t.split())].kept for i, t in enumerate(junk))
    kept = Q.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in Q.assess(docs, labels).where("kept").collect())


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    docs = documents(spark, sample()[0][:5])
    assert {r.ratio for r in Q.assess(docs, none).collect()} == {0.0}
    assert Q.assess(docs.limit(0), none).count() == 0
    assert {r.score for r in C.score(docs, none).collect()} == {0.5}
    assert C.score(docs.limit(0), none).count() == 0


def test_classifier_on_held_out_rows(spark):
    clean, junk = prose(9, 150, words=200), [t.replace(" ", "### ") for t in prose(10, 150, words=200)]
    docs = documents(spark, [*clean, *junk, *ODD], repeat=[0])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], LABELS)
    first = by_id(C.score(docs, labels), "doc_id", "held_out", "score", "predicted")
    held = [(d, s, p) for d, h, s, p in first if h and d < 300]
    assert all(h == (d is not None and crc32(str(d).encode()) % 4 == 2) for d, h, *_ in first)
    assert sum((d < 150) == bool(p) for d, _, p in held) / len(held) >= 0.9
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, _, s, p in first)
    assert len(first) == 300 + len(ODD) + 2
    again = by_id(C.score(docs.repartition(5), labels), "doc_id", "held_out", "score", "predicted")
    assert [x[3] for x in again] == [x[3] for x in first]


def test_chunks_cover_the_text():
    for n in (0, 1, C.CHUNK, C.CHUNK + 1, C.CHUNK + C.STRIDE, 5000):
        raw = bytes(k % 251 + 1 for k in range(n)).decode("latin-1").encode()
        got = C.chunks(raw.decode())
        assert b"".join([got[0].tobytes(), *(x[C.CHUNK - C.STRIDE :].tobytes() for x in got[1:])]).rstrip(b"\0") == raw


def test_pair_tables_equal_the_filters():
    net, x = C.Net(), np.random.default_rng(0).integers(0, 256, (5, C.CHUNK), dtype=np.uint8)
    want = np.tanh(np.max([sum(net.filters[k][x[:, p + k]] for k in range(C.WIDTH)) for p in range(0, C.CHUNK - C.WIDTH + 1, 2)], axis=0))
    assert np.allclose(C.Scorer(net).pooled(x), want, atol=1e-5)


def test_training_sends_one_row_for_an_id(spark):
    """Rows that repeat an id are reduced before they are fetched, to the least text hash."""
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id % 30) AS text")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], LABELS)
    texts, marks = C.training_rows(docs, labels, "doc_id", "text")
    kept = spark.range(30).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text", "xxhash64(concat('text ', id)) AS h").collect()
    want = {}
    for r in sorted(kept, key=lambda r: r.h):
        want.setdefault(r.doc_id, r.text)
    want = {i: t for i, t in want.items() if crc32(str(i).encode()) % 4 != 2}
    assert [bytes(t[0]).rstrip(b"\0").decode() for t in texts] == [want[i] for i in sorted(want)]
    assert marks.tolist() == [i % 2 for i in sorted(want)]


def test_score_of_a_text_by_hand(spark):
    """Chunks, filters, pooling and the dense layers, one byte at a time."""
    net, rnd = C.Net(seed=3), np.random.default_rng(1)
    text = bytes(rnd.integers(32, 127, 1300).tolist()).decode()
    for t in (text, "short", ""):
        raw, rows, at = t.encode(), [], 0
        while True:
            chunk = raw[at : at + C.CHUNK].ljust(C.CHUNK, b"\0")
            best = np.full(C.FILTERS, -np.inf)
            for k in range(0, C.CHUNK - C.WIDTH + 1, 2):
                best = np.maximum(best, sum(net.filters[j][chunk[k + j]] for j in range(C.WIDTH)))
            rows.append(np.tanh(best))
            if at + C.CHUNK >= len(raw):
                break
            at += C.STRIDE
        features = np.concatenate([np.max(rows, 0), np.mean(rows, 0)])
        hidden = np.tanh(features @ net.w1 + net.b1)
        want = 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2[0])))
        assert C.Scorer(net).score([t, text])[0] == pytest.approx(want, abs=1e-5)
