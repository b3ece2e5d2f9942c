import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from helpers import ODD, by_id, documents, prose
from tokenizers import Tokenizer

from loctrack.llm import bytebpe as B
from loctrack.llm import token_counts as C
from loctrack.llm.queries import BYTE_BPE, WORD_BPE

ALPHABET = "abcdefghijklmnopqrstuvwxyz'' 's're  \n\t!?#é漢ΣςİſßÅ①½٣😀\xa0　́\x1c\x85<|endoftext|>"


def fuzz(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


TEXTS = [*ODD[1:], *prose(6, 50), *fuzz(400), "a" * 3000, "the" * 500, "''s", "'re'r'v 'l'll", "<|startoftext|>x<|endoftext|>"]


def test_bytes_match_the_library(spark):
    path = P.path(BYTE_BPE)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.ByteBpe.load(path, P.PATTERN).ranks, special_tokens={})
    docs = documents(spark, [None, *TEXTS], repeat=[2])
    got = by_id(B.digests(docs, path, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = B.decode(B.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert by_id(back, "doc_id", "text") == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)


def test_long_texts_in_parts(monkeypatch):
    bpe = B.ByteBpe(P.path(BYTE_BPE), P.PATTERN)
    text = " ".join(TEXTS)
    whole = b"".join(bpe.encode(text))
    monkeypatch.setattr(B, "WHOLE_CHARS", 10)
    monkeypatch.setattr(B, "PIECES", 7)
    assert b"".join(bpe.encode(text)) == whole
    assert bpe.decode(whole).decode() == text
    assert b"".join(bpe.encode("a\ud800b")) == b"".join(bpe.encode("a?b"))


@pytest.mark.parametrize("chunk", [C.CHUNK, 5])
def test_counts_match_the_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "STATES", 3000)
    lib, own = Tokenizer.from_file(P.path(WORD_BPE)), C.Transducer(P.path(WORD_BPE))
    for t in TEXTS:
        assert own.count(t, chunk) == len(lib.encode(t, add_special_tokens=False).ids), t
    docs = documents(spark, [None, *TEXTS], repeat=[1])
    got = by_id(C.token_counts(docs, P.path(WORD_BPE), limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = {t: len(lib.encode(t, add_special_tokens=False).ids) for t in [*TEXTS, "", "no id"]}
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), n[r.text or ""], n[r.text or ""] > 100) for r in docs.collect()), key=repr)


def test_empty_tables(spark):
    docs = documents(spark, []).limit(0)
    assert B.digests(docs, P.path(BYTE_BPE), P.PATTERN).count() == C.token_counts(docs, P.path(WORD_BPE)).count() == 0


def test_states_stay_bounded_inside_a_text(monkeypatch):
    import random

    from loctrack.llm import token_counts
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "STATES", 500)
    t, most = token_counts.Transducer(P.path("word_bpe_49k.json")), 0
    state = t.state

    def counted(*key):
        nonlocal most
        out = state(*key)
        most = max(most, len(t.states))
        return out

    monkeypatch.setattr(t, "state", counted)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    for text in ("".join(rnd.choice("abcdefgh") for _ in range(5000)), "".join(rnd.choice("abc1 \n'é") for _ in range(5000)), "word " * 500):
        for chunk in (64, 1 << 14):
            assert t.count(text, chunk) == len(lib.encode(text, add_special_tokens=False).ids)
    assert 400 < most <= 501
