"""Benchmark decontamination by a positional inverted index (operator 1).

``build_index`` cuts the training rows into segments of bounded token counts and
stores, for each segment, its terms and their position lists.  ``find_matches``
asks the stored index for every window of the benchmark items: a segment's terms
call up the windows whose two rarest words they are; for each it starts from the
window's rarest term in the segment, shifts the position lists by the
offsets of the terms, and intersects list after list, rarest first.  With a
slop of 0 a match is an exact phrase; with slop s it is a proximity match, in
which each word lies at most s words from its place in a window put somewhere.

The index is sharded by document, so no term, however frequent, gathers in one
task, and nothing but small rows for each document is shuffled.  The benchmark
is the stated query set; it is read in blocks of bounded size, and where there
are several, each one's matches are written before the next is read.

Defined cases: a null or empty text has no words and no matches; an item with
no words has no window; a null item_id is an item of its own; rows that repeat a doc_id are told apart and each gets
its own row; a null doc_id is kept; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.llm.common import keyed, slices, written

#: Words of a window of the benchmark.
WINDOW = 10
#: Words off its place at most, in a proximity match.
SLOP = 2
#: Words of an index segment at most, but for a longer single document.
SEGMENT_WORDS = 1 << 16
#: Candidate starts that are intersected at a time.
CANDIDATES = 1 << 18
#: Bytes of benchmark text that are sent to the tasks at a time.
BLOCK_BYTES = 8 << 20

#: Upper-case ASCII letters become lower-case; what is not in a word, a space.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

INDEX_SCHEMA = "ids array<bigint>, hashes array<bigint>, starts binary, terms binary, counts binary, positions binary"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _segment(ids: list, hashes: list, starts: list[int], vocab: dict[bytes, int], tokens: list[np.ndarray]) -> pa.RecordBatch:
    of = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
    order = np.argsort(of, kind="stable").astype(np.int32)
    counts = np.bincount(of, minlength=len(vocab)).astype(np.int32)
    columns = [[ids], [hashes], [np.array([*starts, len(of)], np.int64).tobytes()], [b" ".join(vocab)], [counts.tobytes()], [order.tobytes()]]
    kinds = [*[pa.list_(pa.int64())] * 2, *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "hashes", "starts", "terms", "counts", "positions"])


def _index_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, hashes, starts, vocab, tokens, n = [], [], [], {}, [], 0
    for batch in slices(batches):
        for key, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = words(text)
            if ids and n + len(found) > SEGMENT_WORDS:
                yield _segment(ids, hashes, starts, vocab, tokens)
                ids, hashes, starts, vocab, tokens, n = [], [], [], {}, [], 0
            ids.append(key)
            hashes.append(text_hash)
            starts.append(n)
            add = vocab.setdefault
            tokens.append(np.fromiter((add(w, len(vocab)) for w in found), np.int32, len(found)))
            n += len(found)
    if ids:
        yield _segment(ids, hashes, starts, vocab, tokens)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row for each segment, with the documents' ids,
    text hashes and first positions, the terms, and the terms' counts and position lists."""
    rows = keyed(docs, id_col, text_col).select(F.col("id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return written(rows.mapInArrow(_index_tasks, INDEX_SCHEMA).select(F.monotonically_increasing_id().alias("segment"), "*"), "index")


@dataclass
class Queries:
    """The windows of a block of items: words by number, -1 behind the end; items
    by their place in ids.  Windows are found from their two rarest words among
    all windows: ``of_word`` lists them by the rarest, from ``first`` on, and
    ``second`` is the other."""

    number: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    ids: list

    def __post_init__(self) -> None:
        n, there = len(self.number), self.windows >= 0
        often = np.append(np.bincount(self.windows[there], minlength=n), np.iinfo(np.int64).max)
        rare = np.argsort(often[self.windows], axis=1, kind="stable")[:, :2]
        key, self.second = (np.take_along_axis(self.windows, rare[:, k : k + 1], 1)[:, 0] for k in (0, min(1, rare.shape[1] - 1)))
        self.second = np.where(self.second < 0, key, self.second)
        self.of_word = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[self.of_word], np.arange(n + 1))

    def candidates(self, there: np.ndarray, present: np.ndarray) -> np.ndarray:
        """The windows whose two rarest words a segment holds: ``there`` says it
        for every word, ``present`` lists those held."""
        low, high = self.first[present], self.first[present + 1]
        n = high - low
        rows = self.of_word[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        return np.sort(rows[there[self.second[rows]]])


def windows_of(items: list[tuple[int | None, str | None]], size: int = WINDOW) -> Queries:
    vocab: dict[bytes, int] = {}
    seen: dict[tuple, None] = {}
    places: dict[int | None, int] = {}
    for key, text in items:
        item = places.setdefault(key, len(places))
        of = [vocab.setdefault(w, len(vocab)) for w in words(text)]
        for at in range(max(1, len(of) - size + 1) if of else 0):
            seen[item, tuple(of[at : at + size])] = None
    filled = np.full((len(seen), size), -1, np.int32)
    for i, (_, w) in enumerate(seen):
        filled[i, : len(w)] = w
    return Queries(vocab, filled, (filled >= 0).sum(1), np.array([i for i, _ in seen], np.int64), list(places))


class Segment:
    """One row of the index, ready for intersections."""

    def __init__(self, starts: bytes, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.starts = np.frombuffer(starts, np.int64)
        self.size = int(self.starts[-1]) + 1
        self.terms = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        # term and position in one number: all lists, one behind the other, in order
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.size + self.positions

    def matches(self, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and window numbers of all matches.  The segment's words
        are looked up among the windows', not the other way round, so the work
        grows with the segment and the windows that its words call for."""
        held = [(n, i) for t, i in self.terms.items() if (n := q.number.get(t)) is not None]
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        if not held:
            return none
        local = np.full(len(q.number), -1, np.int64)
        present, own = np.array(held, np.int64).T
        local[present] = own
        rows = q.candidates(local >= 0, present)
        term = np.where(q.windows[rows] >= 0, local[q.windows[rows]], -2)
        whole = ~(term == -1).any(1)
        rows, term = rows[whole], term[whole]
        count = np.where(term >= 0, self.counts[term.clip(0)], np.iinfo(np.int64).max)
        found = [none]
        anchors = count.min(1) if len(rows) else np.empty(0, np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(anchors) // CANDIDATES)) + 1
        for part in np.split(np.arange(len(rows)), cuts):
            start, of = self._intersect(part, term, count, slop)
            found.append((start, rows[of]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _intersect(self, part: np.ndarray, term: np.ndarray, count: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(part):
            return np.empty(0, np.int64), part
        order = np.argsort(count[part], axis=1, kind="stable")
        rarest = term[part, order[:, 0]]
        n = self.counts[rarest]
        row = np.repeat(np.arange(len(part)), n)
        anchor = self.positions[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[rarest[row]]]
        doc = np.searchsorted(self.starts, anchor, "right") - 1
        start, shift = anchor - order[row, 0], np.arange(-slop, slop + 1)
        row, doc, start = np.repeat(row, len(shift)), np.repeat(doc, len(shift)), (start[:, None] + shift).ravel()
        for k in range(1, term.shape[1]):
            if not len(row):
                break
            offset = order[row, k]
            wanted = term[part[row], offset]
            low = wanted * self.size + np.maximum(start + offset - slop, self.starts[doc])
            high = wanted * self.size + np.minimum(start + offset + slop, self.starts[doc + 1] - 1)
            there = self.keys[np.searchsorted(self.keys, low).clip(0, len(self.keys) - 1)]
            keep = (wanted == -2) | (there >= low) & (there <= high)
            row, doc, start = row[keep], doc[keep], start[keep]
        return start.clip(self.starts[doc], self.starts[doc + 1] - 1), part[row]


MATCH_SCHEMA = "segment bigint, ordinal int, doc_id bigint, text_hash bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>, near array<bigint>"


def _by_document(seg: Segment, starts: np.ndarray, q: Queries, of: np.ndarray) -> list[list[int]]:
    """The items of the matches of each document, once each."""
    doc = np.searchsorted(seg.starts, starts, "right") - 1
    out: list[list[int | None]] = [[] for _ in range(len(seg.starts) - 1)]
    for d, w in np.unique(np.stack([doc, q.items[of]], 1), axis=0).tolist() if len(doc) else []:
        out[d].append(q.ids[w])
    return out


def _spans(seg: Segment, starts: np.ndarray, q: Queries, of: np.ndarray) -> list[list[dict]]:
    """Covered words of each document, as merged spans."""
    out: list[list[dict]] = [[] for _ in range(len(seg.starts) - 1)]
    if len(starts):
        step = np.zeros(seg.size + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + q.lengths[of], -1)
        hit = np.concatenate([[False], np.cumsum(step) > 0])
        first = seg.starts[:-1]
        edge = np.diff(hit.astype(np.int8))
        a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while x < y:  # spans of neighbouring documents may touch
                d = int(np.searchsorted(first, x, "right")) - 1
                z = min(y, int(seg.starts[d + 1]))
                out[d].append({"start": x - int(first[d]), "end": z - int(first[d])})
                x = z
    return out


def find_matches(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """A row for each document of the index and block of items: its words, the
    spans covered by exact phrases, the items with such phrases, and the items
    with proximity matches (none are looked for if ``slop`` is None)."""
    rows = keyed(items, item_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    found = None
    for block in range(blocks):
        q = windows_of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()], window)

        def tasks(batches: Iterator[pa.RecordBatch], q: Queries = q) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                r = {k: v[0] for k, v in batch.to_pydict().items()}
                seg = Segment(r["starts"], r["terms"], r["counts"], r["positions"])
                exact = seg.matches(q, 0)
                near = seg.matches(q, slop) if slop is not None else (exact[0][:0], exact[1][:0])
                n = len(seg.starts) - 1
                columns = [[r["segment"]] * n, range(n), r["ids"], r["hashes"], np.diff(seg.starts), _spans(seg, exact[0], q, exact[1]), _by_document(seg, exact[0], q, exact[1]), _by_document(seg, near[0], q, near[1])]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["segment", "ordinal", "doc_id", "text_hash", "n_words", "spans", "items", "near"])

        part = index.mapInArrow(tasks, MATCH_SCHEMA)
        if blocks > 1:
            part = written(part, "matches")
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """A row for each document: its id and the hash of its text, words, words inside exact phrases, the items
    with such phrases and those with proximity matches."""
    found = find_matches(build_index(docs, id_col, text_col), items, item_col, item_text_col, window, slop)
    covered = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    return found.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), covered.alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near_items"),
    ).drop("segment", "ordinal")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int | None = SLOP) -> DataFrame:
    """``docs`` without the documents that hold a window of an item, as an exact
    phrase or, unless ``slop`` is None, as a proximity match.  Rows are told by id
    and text, so others that share an id, or have none, stay.  Rows travel packed,
    so other columns may have any names."""
    found = contamination(docs, items, id_col, text_col, slop=slop).where("n_hit > 0 or size(near_items) > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("key_hash"))
    return rows.join(found, rows.key.eqNullSafe(found.hit_id) & (rows.key_hash == found.hit_hash), "left_anti").select("doc.*")
