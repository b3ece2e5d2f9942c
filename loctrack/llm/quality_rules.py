"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio
(operator 4).

The n-grams are the ``GRAM`` bytes long pieces of the UTF-8 text, hashed into
``BUCKETS``; unlike word n-grams they need few trusted rows for a stable
multinomial.  One pass counts them over the whole corpus and over its trusted
part, which gives two multinomials; the trusted one is smoothed with the raw one.  A second pass gives each document
the mean over its n-grams of log(p_trusted / p_raw), and keeps it if no base
rule fails and the mean is at least ``THRESHOLD``.  The same counts give the
same verdict for every document, wherever it lies.

What is gathered is one table of ``BUCKETS`` counts, whatever the input's size;
each task adds up its own rows first.

Defined cases: a null or empty text has no words, fails the base rules and has
ratio 0; rows that repeat a doc_id are each counted and returned; labels that
repeat a doc_id trust its rows once; a null doc_id is never trusted; an empty
table gives an empty result; without any trusted row all ratios are 0.  A very
long text is held by one task as its words and n-grams, some thirty times its
bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.llm.common import slices

#: Bytes of an n-gram; hash buckets.
GRAM, BUCKETS = 3, 1 << 16
#: Pseudo-count of the raw multinomial in the trusted one, as a share of n-grams.
SMOOTHING = 0.01
#: Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside three-word windows found twice or more; equal numbers mean
    equal words."""
    if len(numbers) < 4:
        return 0
    m = int(numbers.max()) + 1
    pairs = np.unique(numbers[:-1] * m + numbers[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * m + numbers[2:], return_inverse=True, return_counts=True)
    found = n[at] > 1
    inside = np.zeros(len(numbers), bool)
    for k in range(3):
        inside[k : len(found) + k] |= found
    return int(inside.sum())


def base_counts(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    local: dict[bytes, int] = {}
    numbers = np.fromiter((local.setdefault(w, len(local)) for w in words), np.int64, len(words))
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(numbers)


def buckets(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a text with a space on either side."""
    if not text:
        return np.empty(0, np.int32)
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)
    n = max(0, len(raw) - GRAM + 1)
    grams = np.zeros(n, np.uint32)
    for k in range(GRAM):
        grams = grams * np.uint32(257) + raw[k : n + k]
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int32)


def gram_counts(rows: DataFrame, trusted_col: str) -> DataFrame:
    """(bucket, n_trusted, n_raw) over all rows (text, trusted)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches, 200):
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for side, some in ((0, [t for t, m in zip(texts, marks, strict=True) if m]), (1, [t for t, m in zip(texts, marks, strict=True) if not m])):
                if some:
                    counts[side] += np.bincount(np.concatenate([buckets(t) for t in some]), minlength=BUCKETS)
        counts[1] += counts[0]
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "n_trusted", "n_raw"])

    parts = rows.select("text", trusted_col).mapInArrow(tasks, "bucket int, n_trusted bigint, n_raw bigint")
    return parts.groupBy("bucket").agg(F.sum("n_trusted").alias("n_trusted"), F.sum("n_raw").alias("n_raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket; at most BUCKETS rows come back."""
    trusted, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        trusted[r.bucket], raw[r.bucket] = r.n_trusted, r.n_raw
    if not trusted.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1) / (raw + 1).sum()
    weight = 1 + SMOOTHING * trusted.sum()
    return np.log((trusted + weight * p) / (trusted.sum() + weight) / p)


def corpus_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratios, from all of ``docs``.  ``labels`` (doc_id, quality)
    trusts the documents of quality 1."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    trust = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    # labels grow with the corpus, so they are never broadcast, at any size
    return log_ratios(gram_counts(rows.join(trust.hint("merge"), "doc_id", "left"), "trusted"))


def verdict(text: str | None, ratios: np.ndarray) -> tuple:
    """The base counts and the mean ratio of one text."""
    words = text.encode("utf-8", "replace").split() if text else []
    return (*base_counts(text, words), float(ratios[buckets(text)].mean()) if text else 0.0)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: the base counts, base_failed, the ratio, and kept."""
    ratios = corpus_ratios(docs, labels, id_col, text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = [verdict(t, ratios) for t in batch.column(1).to_pylist()]
            failed = [fails_base(v[0], v[4]) for v in out]
            columns = [pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
            kept = [not f and v[5] >= threshold for f, v in zip(failed, out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed), pa.array(kept)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept"])

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, base_failed boolean, kept boolean"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tasks, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    ratios = corpus_ratios(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = [verdict(t, ratios) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not fails_base(v[0], v[4]) and v[5] >= threshold for v in out], pa.bool_()))

    return docs.mapInArrow(tasks, docs.schema)
