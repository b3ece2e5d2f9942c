import hashlib
import re

import pytest
from helpers import ODD, by_id, documents, prose

from loctrack.llm import decontaminate as D

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, size):
    doc = words(text)
    hit, found = set(), set()
    for item, body in items:
        w = words(body)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            win = w[k : k + size]
            for s in range(len(doc) - len(win) + 1):
                if doc[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("segment", [20, 1 << 18])
def test_exact_phrases(spark, monkeypatch, segment):
    monkeypatch.setattr(D, "SEGMENT_WORDS", segment)
    base = prose(1, 40)
    items = [(0, base[0]), (10, base[1].upper()), (9, "a b c"), (3, ""), (4, None), (5, "one"), (6, " ".join(base[3].split()[:12])), (6, "a"), (7, "a a a")]
    texts = [*base, *ODD, base[0] + " " + base[1], "a-b. C a b c one ONE", "a a a a a", "a b a b c a b c", "a,b", "É one"]
    docs = documents(spark, texts, repeat=[0, 3])
    got = D.contamination(docs, spark.createDataFrame(items, ITEMS), window=5)
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items").collect()), key=repr)
    want = sorted(((r.doc_id, n, h, i) for r in docs.collect() for n, h, i in [brute(r.text, items, 5)]), key=repr)
    assert [(a, b, c, sorted(d)) for a, b, c, d in rows] == want


def test_blocks_of_items_agree(spark, monkeypatch):
    base = prose(2, 60)
    items = spark.createDataFrame(list(enumerate(base[:20])), ITEMS)
    docs = documents(spark, base)
    one = by_id(D.contamination(docs, items), "doc_id", "n_hit")
    monkeypatch.setattr(D, "BLOCK_BYTES", 700)
    monkeypatch.setattr(D, "CANDIDATES", 3)
    assert by_id(D.contamination(docs, items), "doc_id", "n_hit") == one
    assert sum(r[1] for r in one) > 100


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], ITEMS)
    texts = ["alpha beta gamma delta", "alpha x beta gamma delta", "beta alpha gamma delta", "alpha beta x y z q gamma delta", "delta gamma beta x alpha", "alpha beta gamma"]
    got = {r.doc_id: (r.n_hit, list(r.near_items)) for r in D.contamination(documents(spark, texts), items, slop=1).collect()}
    assert [got[i] for i in range(6)] == [(4, [1]), (0, [1]), (0, [1]), (0, []), (0, []), (0, [])]


def test_empty_tables(spark):
    items = spark.createDataFrame([], ITEMS)
    docs = documents(spark, ["a b"])
    assert by_id(D.contamination(docs, items), "doc_id", "n_hit") == [(0, 0), (None, 0)]
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.drop_contaminated(docs, spark.createDataFrame([(1, "a b")], ITEMS)).columns == docs.columns
    assert [r.doc_id for r in D.drop_contaminated(docs, spark.createDataFrame([(1, "A b!")], ITEMS)).collect()] == [None]


def test_query_digest(spark):
    from pyspark.sql import functions as F

    from loctrack.llm.queries import digest_of

    got = spark.createDataFrame([([10, 9, 2],), ([],)], "i array<long>").select(digest_of(F.col("i"))).collect()
    assert [r[0] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"10,2,9", b"")]


def test_proximity_in_query_and_stage(spark, tmp_path):
    from loctrack.llm import queries as Q

    w = [f"w{i}" for i in range(30)]
    inserted = [x for i, x in enumerate(w) for x in ([x, "new"] if i % 9 == 8 else [x])]
    swapped = [w[i ^ 1] for i in range(30)]
    texts = [" ".join(w), " ".join(inserted), " ".join(swapped), "w0 clean w1 text"]
    docs, items = documents(spark, texts), spark.createDataFrame([(7, " ".join(w))], ITEMS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in Q.op1_near_items(spark, str(tmp_path)).collect()}
    assert [got[i].n_items for i in range(4)] == [1, 0, 0, 0]
    assert [got[i].n_near_items for i in range(4)] == [1, 1, 1, 0]
    assert got[1].near_sha256 == hashlib.sha256(b"7").hexdigest() and not got[1].contaminated
    assert by_id(D.drop_contaminated(docs, items), "doc_id") == [(3,), (None,)]
    assert by_id(D.drop_contaminated(docs, items, slop=None), "doc_id") == [(1,), (2,), (3,), (None,)]


def test_rows_that_share_an_id_are_dropped_alone(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "clean one"), (None, "clean two"), (None, None), (4, "x a b y"), (4, "clean three"), (4, "clean three"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    got = D.drop_contaminated(docs, spark.createDataFrame([(1, "a b")], ITEMS))
    assert by_id(got, "doc_id", "text") == sorted([(None, "clean one"), (None, "clean two"), (None, None), (4, "clean three"), (4, "clean three")], key=repr)


def test_null_item_id_and_written_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(None, "a b"), (2, "c d"), (3, "e f")], ITEMS)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f"), (3, "x")], "doc_id long, text string")
    want = [(1, 4, [2, None]), (2, 2, [3]), (3, 0, [])]
    get = lambda: sorted((r.doc_id, r.n_hit, sorted(r["items"], key=lambda i: (i is None, i))) for r in D.contamination(docs, items).collect())
    assert get() == want
    names, old = [], D.written
    monkeypatch.setattr(D, "written", lambda df, what: names.append(what) or old(df, what))
    monkeypatch.setattr(D, "BLOCK_BYTES", 4)
    assert get() == want
    assert names == ["index", "matches", "matches", "matches"]


def brute_near(text, items, size, slop):
    doc, found = words(text), set()
    for item, body in items:
        w = words(body)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            win = w[k : k + size]
            for s in range(-size - slop, len(doc) + slop):
                if all(x in doc[max(0, s + i - slop) : max(0, s + i + slop + 1)] for i, x in enumerate(win)):
                    found.add(item)
    return sorted(found)


@pytest.mark.parametrize("slop", [0, 1, 3])
@pytest.mark.parametrize("segment", [30, 1 << 16])
def test_proximity_against_brute_force(spark, monkeypatch, slop, segment):
    import random

    monkeypatch.setattr(D, "SEGMENT_WORDS", segment)
    rnd = random.Random(slop)
    text = lambda n, v: " ".join(rnd.choice("abcdefghijkl"[:v]) for _ in range(n))
    items = [(i, text(rnd.randint(1, 9), 12)) for i in range(25)] + [(40, "a a a"), (41, "nowhere at all"), (42, None)]
    texts = [text(rnd.randint(0, 40), 12) for _ in range(40)] + [text(30, 3), "a", "a a"]
    docs = documents(spark, texts)
    got = {r.doc_id: (sorted(r["items"]), sorted(r.near_items)) for r in D.contamination(docs, spark.createDataFrame(items, ITEMS), window=4, slop=slop).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        assert got[i] == (brute(t, items, 4)[2], brute_near(t, items, 4, slop)), (t, i)
    assert sum(len(n) > len(e) for e, n in got.values()) > 5 or not slop


def test_work_for_a_segment_does_not_grow_with_the_benchmark():
    """Windows that share no word with a segment cost it next to nothing."""
    import time

    def seconds(n):
        q = D.windows_of([(i, " ".join(f"q{i}x{k % 40}" for k in range(50))) for i in range(n)])
        text = " ".join(f"w{k % 9000}" for k in range(60_000))
        vocab = {}
        of = [vocab.setdefault(w, len(vocab)) for w in D.words(text)]
        row = D._segment([1], [1], [0], vocab, [D.np.array(of, D.np.int32)]).to_pydict()
        seg = D.Segment(*(row[c][0] for c in ("starts", "terms", "counts", "positions")))
        t0 = time.perf_counter()
        for _ in range(20):
            assert not len(seg.matches(q, 2)[0])
        return len(q.windows), time.perf_counter() - t0

    (few, a), (many, b) = seconds(100), seconds(8000)
    assert many > 50 * few and b < 10 * a + 0.5
