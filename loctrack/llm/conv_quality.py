"""Quality classifier: a byte-level convolutional network in numpy (operator 5).

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters run over each chunk (``WIDTH`` bytes wide, every ``WIDTH // 2``
bytes), and each filter's maximum is taken over the chunk.  Maximum and mean of
these over the chunks go through a small hidden layer into one probability.

The network is trained on the driver on a bounded sample of the labelled rows
(``SAMPLE`` of each class, ``SAMPLE_CHUNKS`` chunks of each text, evenly over
it); scoring reads whole texts.  The sample is picked by a hash of the id, so it
is the same wherever the rows lie.  Rows whose crc32(id) mod 4 is 2 are held out.

Defined cases: a null or empty text is one chunk of zero bytes and gets a score
like any other; rows that repeat are each returned; a null doc_id is not held
out and never trained on; labels without both classes give 0.5 everywhere; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.llm.common import keyed, slices

WIDTH, FILTERS, HIDDEN = 4, 24, 16
#: Bytes of a chunk, and from one chunk's start to the next.
CHUNK, STRIDE = 512, 448
#: Training rows of each class, and chunks of each, at most.
SAMPLE, SAMPLE_CHUNKS = 1500, 8
STEPS, BATCH, RATE = 500, 32, 0.01
#: Share of good rows that are cut to a short piece in a training step, and its
#: bytes: a piece of a good text is good, and few labelled texts are short.
CUT_SHARE, CUT_BYTES = 0.15, (10, 200)
#: Score from which the prediction is 1.
CUT = 0.7
#: Chunks that are scored at a time.
SCORED = 2048


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes, zero behind the end."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(raw) - (CHUNK - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


class Net:
    """Filters (WIDTH, 256, FILTERS) and two dense layers."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.w1 = rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w1 + self.b1)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2[0], -30, 30)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Net:
        """Adam, at a falling rate, on batches with as many rows of either class."""
        rng = np.random.default_rng(seed)
        params = [self.filters, self.w1, self.b1, self.w2, self.b2]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        sides = [np.flatnonzero(labels == k) for k in (0, 1)]
        at = np.arange(0, CHUNK - WIDTH + 1, WIDTH // 2)
        for step in range(1, STEPS + 1):
            rows = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
            picked = [texts[r] for r in rows]
            for i in np.flatnonzero((labels[rows] == 1) & (rng.random(BATCH) < CUT_SHARE)):
                piece = np.zeros((1, CHUNK), np.uint8)
                n = rng.integers(*CUT_BYTES)
                piece[0, :n] = picked[i][rng.integers(len(picked[i])), :n]
                picked[i] = piece
            of = np.repeat(np.arange(BATCH), [len(p) for p in picked])
            x, y = np.concatenate(picked), labels[rows]
            z = sum(self.filters[k][x[:, at + k]] for k in range(WIDTH))
            best = z.argmax(1)
            pooled = np.tanh(np.take_along_axis(z, best[:, None], 1)[:, 0])
            first = np.flatnonzero(np.diff(of, prepend=-1))
            n = np.diff(np.append(first, len(of)))[:, None]
            top, mean = np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / n
            hidden, p = self.head(np.concatenate([top, mean], 1))
            d = ((p - y) / BATCH).astype(np.float32)
            dh = d[:, None] * self.w2 * (1 - hidden**2)
            dx = dh @ self.w1.T
            dp = (dx[:, FILTERS:] / n)[of] + np.where(pooled == top[of], dx[of, :FILTERS], 0)
            dz = (dp * (1 - pooled**2)).astype(np.float32)
            df = np.zeros_like(self.filters)
            chunk, filt = np.arange(len(x))[:, None], np.arange(FILTERS)
            for k in range(WIDTH):
                np.add.at(df[k], (x[chunk, at[best] + k], filt), dz)
            grads = [df, np.concatenate([top, mean], 1).T @ dh + 1e-4 * self.w1, dh.sum(0), hidden.T @ d, d.sum(keepdims=True)]
            for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                q -= (RATE * (1 - step / (STEPS + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


class Scorer:
    """A trained net with its filters as tables over pairs of bytes."""

    def __init__(self, net: Net) -> None:
        self.net = net
        low, high = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
        self.pairs = [net.filters[k][low] + net.filters[k + 1][high] for k in range(0, WIDTH, 2)]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(n, FILTERS) maxima over the chunks (n, CHUNK)."""
        code = np.ascontiguousarray(x).view("<u2")
        n = code.shape[1] - len(self.pairs) + 1
        out = np.empty((len(x), FILTERS), np.float32)
        for at in range(0, len(x), 64):
            part = code[at : at + 64]
            z = self.pairs[0][part[:, :n]]
            for k, table in enumerate(self.pairs[1:], 1):
                z += table[part[:, k : k + n]]
            out[at : at + 64] = z.max(1)
        return np.tanh(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        features, held, waiting = [], [], 0
        top, total, count = (np.full((len(texts), FILTERS), -1, np.float32), np.zeros((len(texts), FILTERS)), np.zeros(len(texts)))

        def flush() -> None:
            of = np.concatenate([np.full(len(c), i) for i, c in held])
            pooled = self.pooled(np.concatenate([c for _, c in held]))
            np.maximum.at(top, of, pooled)
            np.add.at(total, of, pooled)
            np.add.at(count, of, 1)

        for i, text in enumerate(texts):
            whole = chunks(text)
            for at in range(0, len(whole), SCORED):
                held.append((i, whole[at : at + SCORED]))
                waiting += len(held[-1][1])
                if waiting >= SCORED:
                    flush()
                    held, waiting = [], 0
        if held:
            flush()
        features = np.concatenate([top, total / np.maximum(count, 1)[:, None]], 1)
        return self.net.head(features)[1]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The bounded sample: chunks and labels."""
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = [{r.doc_id for r in marked.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()} for k in (0, 1)]
    wanted = sorted(ids[0] | ids[1])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                whole = chunks(text)
                out.append(whole[np.unique(np.linspace(0, len(whole) - 1, SAMPLE_CHUNKS).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "text_hash", "chunks"])

    rows = keyed(docs, id_col, text_col).select(F.col("id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).where(F.col("id").isin(wanted)).mapInArrow(tasks, "doc_id bigint, text_hash bigint, chunks binary")
    # of rows that repeat an id, the one of the least text hash: at most one for each id
    rows = rows.groupBy("doc_id").agg(F.min_by("chunks", F.struct("text_hash", "chunks")).alias("chunks"))
    found = {r.doc_id: r.chunks for r in rows.collect()} if wanted else {}
    order = [i for i in wanted if i in found]
    return [np.frombuffer(found[i], np.uint8).reshape(-1, CHUNK) for i in order], np.array([int(i in ids[1]) for i in order])


def held_out(col: str):  # noqa: ANN201
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    texts, marks = training_rows(docs, labels, id_col, text_col)
    net = Net().train(texts, marks) if len(set(marks.tolist())) == 2 else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in slices(batches, 500):
            scores = scorer.score(batch.column(1).to_pylist()) if scorer else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    out = keyed(docs, id_col, text_col).mapInArrow(tasks, "doc_id bigint, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
