"""Importance resampling towards a target distribution (operator 13).

Hashed n-gram counts of the raw rows and of the target texts give a gain for
each bucket; a document's weight is the floored mean of the gains over its
features, read from an array.  Weight and Gumbel noise make a score, and the
highest scores are a draw without replacement.

The cutoff is found by weighted median-of-medians: each task gives the median
of the keys it still holds and their number, the weighted median of these is the
pivot, and at least a quarter of the keys is discarded in each round, in one
pass that also gives the medians of both sides.  Ties are settled by the same
search on the next part of the key.  The winners alone are then sorted.  Through
the driver go one row for each task and round, and the counts of the buckets.

Defined cases: a null text has no words; a document without features weighs 0;
a null doc_id counts as the empty text in the hash and sorts after all others;
rows that repeat a doc_id are each scored, and rows of equal keys are ranked in
any order; empty tables give empty results; other columns are not read.  Long
texts are read in blocks of words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loctrack.llm.common import keyed, slices, written
from loctrack.llm.ordering import ranked

BUCKETS = 10_000
MAX_WORDS = 2
#: Words below which a document is never drawn.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
#: Bytes of a text whose words are alive at a time, at least.
BLOCK = 1 << 20

#: Each byte as part of a word (lower case) or as a space.
_WORD = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def feature_blocks(text: bytes, max_words: int = MAX_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, crc32 of all runs of 1 to ``max_words`` words that end there), by
    blocks of the text.  A run's crc32 goes on from that of the run before."""
    line, at, tail = text.translate(_WORD), 0, []  # tail: crc32 of the runs that end at the last word, longest last
    while at < len(line):
        end = line.find(b" ", at + BLOCK)
        end = len(line) if end < 0 else end
        words, at = line[at:end].split(), end
        if not words:
            continue
        spaced = [b" " + w for w in words]
        runs = [list(map(crc32, words))]
        for k in range(1, max_words):
            head = tail[k - 1 : k]
            last = head + runs[-1][:-1]
            runs.append(list(map(crc32, spaced[len(words) - len(last) :], last)))
        tail = [r[-1] for r in runs if r]
        yield len(words), np.fromiter((c for r in runs for c in r), np.uint32)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Features of all texts by bucket."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 100):
            for text in batch.column(0):
                for _, found in feature_blocks(text.as_py() or b"", max_words):
                    total += np.bincount(found % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).mapInArrow(tasks, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # at most one for each bucket
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log-ratio of the smoothed target and raw shares of each bucket."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: object) -> int:
    """Floored Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, seed: int = SEED) -> DataFrame:
    """(id, row, n_words, n_features, weight, score) of every row."""
    kind = docs.schema[id_col].dataType

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(2), strict=True):
                n_words = n = total = 0
                for words, found in feature_blocks(text.as_py() or b"", max_words):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found % len(gain)].sum())
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + noise(seed, doc_id.as_py())))
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols)], ["id", "row", "n_words", "n_features", "weight", "score"])

    rows = keyed(docs, id_col, text_col).select("id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary"))
    return rows.mapInArrow(tasks, T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("row", "n_words", "n_features", "weight", "score"))]))


def _median(values: np.ndarray) -> object:
    if not len(values):
        return None
    v = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2] if values.dtype != object else sorted(values)[(len(values) - 1) // 2]
    return v.item() if hasattr(v, "item") else v


def _pivot(medians: list[tuple[object, int]]) -> object:
    """The weighted median of the tasks' medians."""
    medians = sorted((m, n) for m, n in medians if n)
    half, seen = sum(n for _, n in medians) / 2, 0
    for m, n in medians:
        seen += n
        if seen >= half:
            return m
    raise ValueError("no keys")


def nth_least(rows: DataFrame, col: str, k: int) -> tuple[object, int, int]:
    """(value, rows below it, rows equal to it) of the ``k``-th least value, from
    1, by weighted median-of-medians.  What remains is written anew whenever it
    is a quarter of what was read."""
    kind = rows.schema[col].dataType
    held = rows.select(F.col(col).alias("v"))

    def split(pivot: object):  # noqa: ANN202
        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b.column(0) for b in batches]
            values = pa.chunked_array(parts).to_numpy() if parts else np.empty(0, np.int64)
            low, high = (values, values[:0]) if pivot is None else (values[values < pivot], values[values > pivot])
            row = {"n_low": len(low), "m_low": _median(low), "n_same": len(values) - len(low) - len(high), "n_high": len(high), "m_high": _median(high)}
            yield from pa.Table.from_pylist([row], schema).to_batches()
        return tasks

    fields = [T.StructField("n_low", T.LongType()), T.StructField("m_low", kind), T.StructField("n_same", T.LongType()), T.StructField("n_high", T.LongType()), T.StructField("m_high", kind)]
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    schema = pa.schema([("n_low", pa.int64()), ("m_low", arrow), ("n_same", pa.int64()), ("n_high", pa.int64()), ("m_high", arrow)])

    def ask(df: DataFrame, pivot: object) -> list[Row]:
        return df.mapInArrow(split(pivot), T.StructType(fields)).collect()  # one row for each task

    found = ask(held, None)
    n = size = sum(r.n_low for r in found)
    if not 1 <= k <= n:
        raise ValueError(f"no value number {k} of {n}")
    medians, below, left = [(r.m_low, r.n_low) for r in found], 0, held
    while True:
        pivot = _pivot(medians)
        found = ask(left, pivot)
        low, same = sum(r.n_low for r in found), sum(r.n_same for r in found)
        if k <= low:
            medians, n, left = [(r.m_low, r.n_low) for r in found], low, left.where(F.col("v") < pivot)
        elif k <= low + same:
            return pivot, below + low, same
        else:
            medians, n, left = [(r.m_high, r.n_high) for r in found], n - low - same, left.where(F.col("v") > pivot)
            below, k = below + low + same, k - low - same
        if n * 4 <= size:
            left, size = written(left, "remaining"), n


def cutoff(rows: DataFrame, keys: list[str], k: int) -> tuple:
    """The ``k``-th least tuple of ``keys``, of which the last tells rows apart."""
    at = []
    for key in keys:
        value, below, same = nth_least(rows, key, k)
        at.append(value)
        rows, k = rows.where(F.col(key) == value), k - below
        if same == k:  # the whole tie is in: any rest of the key is
            break
    return tuple(at)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row of ``docs``;
    rank is 1, 2, 3... from the highest score for the drawn ones, else null."""
    gain = gains(bucket_counts(docs, text_col, buckets, max_words), bucket_counts(target, target_col, buckets, max_words))
    rows = written(scored(docs, gain, id_col, text_col, max_words, seed), "scored")
    kind = rows.schema["id"].dataType
    empty = "" if isinstance(kind, T.StringType) else 0
    keys = {"key0": -F.col("score"), "key1": F.col("id").isNull().cast("int"), "key2": F.coalesce("id", F.lit(empty).cast(kind)), "key3": F.col("row")}
    rows = rows.select("*", *(c.alias(k) for k, c in keys.items()))
    able = F.col("n_words") >= min_words
    n = percent * rows.where(able).count() // 100
    out = ["id", "n_words", "n_features", "weight", "score"]
    if not n:
        return rows.select(*out, F.lit(None).cast("bigint").alias("rank"))
    last = cutoff(rows.where(able), list(keys), n)
    drawn = able & (F.struct(*list(keys)[: len(last)]) <= F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, last))))
    winners = ranked(rows.where(drawn), [F.col(k) for k in keys], "place")
    return winners.select(*out, (F.col("place") + 1).alias("rank")).unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))
