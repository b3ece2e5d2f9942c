"""Winnowing against a plain version, and its match guarantee."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash
from loctrack.llm import queries, winnowing
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, by_id, documents, prose

PIECE = re.compile(r"[^\x20\x09-\x0D]{1,8}")


def brute(text, gram=4, window=8):
    at = [m.span() for m in PIECE.finditer(text or "")]
    if not at:
        return []
    whole = [text[at[i][0] : at[min(i + gram, len(at)) - 1][1]] for i in range(max(1, len(at) - gram + 1))]
    h = [(xxhash.xxh64_intdigest(g.encode(), 42) & 0x7FFFFFFF00000000) >> 32 for g in whole]
    kept = []
    for s in range(max(1, len(h) - window + 1)):
        part = h[s : s + window]
        place = s + max(i for i, x in enumerate(part) if x == min(part))
        if not kept or kept[-1] != (h[place], place):
            kept.append((h[place], place))
    return kept


def alike(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def line(kept):
    return ",".join(f"{h:x}:{p:x}" for h, p in kept)


def expected(docs):
    """docs: (id, text), ids distinct."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), line(brute(t)), line(brute(edited)), alike(brute(t), brute(edited)), alike(brute(t), brute(n))))
    return sorted(out, key=repr)


def found(df):
    return by_id(df.select("id", "n_chars", F.sha2("edited", 256), winnowing.as_text(F.col("fp")), winnowing.as_text(F.col("edited_fp")), "near_edited", "near_next"), "*")


def test_fingerprints(spark):
    texts = [*ODD, *prose(6, 60), " lead and trail \n", "one two three", "one two three four five", "漢字" * 40, "x" * 50_000]
    docs = documents(spark, texts)
    assert found(winnowing.edited_likeness(docs)) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_small_blocks_and_odd_numbers_of_documents(spark):
    for n in (1, 4, 9):
        rows = list(enumerate(prose(n, n)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(winnowing.edited_likeness(docs, block=4)) == expected(rows)


def test_rows_that_repeat_are_each_returned(spark):
    rows = list(enumerate(prose(8, 12)))
    docs = spark.createDataFrame(rows + [rows[3]] * 25 + [rows[4]] * 6, "doc_id long, text string").repartition(4)
    want = expected(rows)
    for copies in (1000, 7, 1):
        got = found(winnowing.edited_likeness(docs, block=4, copies=copies))
        assert got == sorted(want + [r for r in want if r[0] == 3] * 25 + [r for r in want if r[0] == 4] * 6, key=repr)
    assert winnowing.edited_likeness(docs.limit(0)).count() == 0


def test_one_id_with_many_texts(spark):
    docs = spark.createDataFrame([(None, t) for t in prose(2, 9)] + [(3, t) for t in prose(3, 9)], "doc_id long, text string")
    rows = winnowing.edited_likeness(docs, block=2).collect()
    assert len(rows) == 18 and {r.id for r in rows} == {None, 3}


def test_match_guarantee(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 7)))
    rows = []
    for i in range(40):
        shared = [word() for _ in range(winnowing.GRAM + winnowing.WINDOW - 1)]
        for k in (0, 1):
            rows.append((2 * i + k, " ".join([*(word() for _ in range(rnd.randint(0, 60))), *shared, *(word() for _ in range(rnd.randint(0, 60)))])))
    df = winnowing.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), "fp")
    kept = {r.doc_id: {x.hash for x in r.p} for r in df.select("doc_id", winnowing.places(F.col("fp")).alias("p")).collect()}
    assert all(kept[2 * i] & kept[2 * i + 1] for i in range(40))


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = by_id(queries.QUERIES["op12_winnowing"](spark, "/root/testdata/sf0.001"), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert got == expected(docs)
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)
