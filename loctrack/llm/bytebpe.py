"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue
(operator 3).

The merges of a pre-token are picked by a priority queue over ranks: a bucket
for each rank holds positions of a linked list of parts, a bitmap of two levels
marks the buckets in use, and find-first-set on it gives the next rank.  An
entry whose part has changed since is stale and skipped.  A push or pop costs a
few word operations however long the pre-token is.

Encodings of short pre-tokens are kept in a table of bounded size for each
worker process.  Ids and bytes of long texts are digested piece by piece.

Defined cases: a null or empty text gives no ids; lone surrogates, which UTF-8
can't hold, become U+FFFD; rows that repeat are each returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loctrack.llm.common import keyed, slices

#: Encoded pre-tokens that a worker keeps, and the bytes of the longest kept.
KEPT, KEPT_BYTES = 400_000, 48
#: Characters of a text up to which it is split in one go; pieces at a time.
WHOLE_CHARS, PIECES = 1 << 20, 1 << 16


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    The queue is written out in this loop, as it runs once for each rare word of
    the corpus: ``buckets`` (rank to positions, least first), ``words`` (a bit
    for each bucket in use) and ``top`` (a bit for each word in use)."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before, rank = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            rank[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                word = r >> 6
                words[word] = words.get(word, 0) | 1 << (r & 63)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        r = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = buckets[r]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[r]
            bits &= bits - 1
            words[word] = bits
            if not bits:
                top &= top - 1
        if rank[i] != r:
            continue  # stale
        j = after[i]
        k = after[j]
        after[i] = k
        rank[j] = rank[i] = -1
        p = before[i]
        if k < n:
            before[k] = i
            new = get(piece[i : after[k]])
            if new is not None:
                rank[i] = new
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    word = new >> 6
                    words[word] = words.get(word, 0) | 1 << (new & 63)
                    top |= 1 << word
        if p >= 0:
            new = get(piece[p:k])
            if new is None:
                rank[p] = -1
            else:
                rank[p] = new
                if new in buckets:
                    heappush(buckets[new], p)
                else:
                    buckets[new] = [p]
                    word = new >> 6
                    words[word] = words.get(word, 0) | 1 << (new & 63)
                    top |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """A vocabulary of ranks and the pattern that splits texts."""

    _loaded: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(16)]

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= WHOLE_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, PIECES)):
            yield some

    def packed(self, piece: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit numbers."""
        raw = piece.encode()
        ids = merge(raw, self.ranks)
        out = self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= KEPT_BYTES and len(self.kept) < KEPT:
            self.kept[piece] = out
        return out

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, packed, some pre-tokens at a time."""
        if text:
            if not text.isascii():
                text = text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in set(text)) else text
            kept, packed = self.kept, self.packed
            for some in self.pieces(text):
                yield b"".join([kept.get(p) or packed(p) for p in some])

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in memoryview(ids).cast("I")])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded_sha256) for every row: the token ids of the whole
    text, and the digest of the bytes that they decode to."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path, pattern)
        for batch in slices(batches, 200):
            packed = [b"".join(bpe.encode(t)) for t in batch.column(1).to_pylist()]
            ids = [memoryview(p).cast("I").tolist() for p in packed]
            decoded = [hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded_sha256"])

    return keyed(docs, id_col, text_col).mapInArrow(tasks, "doc_id bigint, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from token ids; bytes that are not UTF-8 become U+FFFD."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ByteBpe.load(path, pattern).bytes_of
        for batch in slices(batches, 200):
            texts = [b"".join([of[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(tasks, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: each text
    is encoded and its ids decoded again."""

    def one(bpe: ByteBpe, text: str | None) -> tuple[int, str, str]:
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for some in bpe.encode(text):
            n += len(some) // 4
            ids.update(some)
            decoded.update(bpe.decode(some))
        return n, ids.hexdigest(), decoded.hexdigest()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path, pattern)
        for batch in slices(batches):
            rows = [one(bpe, t) for t in batch.column(1).to_pylist()]
            n, ids, decoded = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed(docs, id_col, text_col).mapInArrow(tasks, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
