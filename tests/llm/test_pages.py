import base64
import gzip
import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyarrow import fs

from loctrack.llm import main_text as M
from loctrack.llm import warc_zip as W
from loctrack.llm.common import new_path

PAGES = "page_id long, url string, html string, payload string, text string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Big site</header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all, please, now.</div><div class="ad">Buy our long and winding thing today.</div>
<{tag}><header><h1>A title &amp; more</h1></header><p><b>First  words<br>of it.<p>Second &eacute;&nbsp;part &lt;x&gt;, with <i>in</i>line text.</p><ul><li>An item</li></ul>
<div class="comments"><p>I disagree with all of this, said a reader. Very much so.</p></div></{tag}>
<aside>Related: other things that you may want to read.</aside><form><label>Mail</label><input><button>Send</button></form>
<footer>&copy; 2024 the site. All rights reserved, as always.</footer>{end}"""
TEXT = "A title & more First words of it. Second é part <x>, with inline text. An item"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post"'])
@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_main_text(tag, end):
    html = PAGE.format(tag=tag, end=end).replace('</div class="post">', "</div>")
    assert M.main_text(html) == TEXT


PROSE = "The first sentence of the story is long enough to be read. And here is the second one, with a clause."


@pytest.mark.parametrize("html", [
    f"<html><head><title>T</title><meta charset=x><body><article><p>{PROSE}</p></article>",
    f"<html><head><title>T</title><link rel=x href=y><div class=post><p>{PROSE}</p></div>",
    f"<html><head><title>T</title>{PROSE}",
    f"<head><script>var a = 1;</script><noscript><style>p{{}}</style></noscript><article>{PROSE}</article>",
    f"<body><form id=aspnetForm><article><p>{PROSE}</p></article></form>",
    f"<body><form id=aspnetForm><div class=content><p>{PROSE}</p></div><label>Name</label><input></form>",
    f"<body class='has-header'><div class='no-sidebar'><article><p>{PROSE}</p></article></div>",
    f"<div class='with-sidebar has-header'><main><p>{PROSE}</p></main></div>",
    f"<div class='widget modal'><article><p>{PROSE}</p></article></div>",
    f"<article><form><input><button>Go</button></form><p>{PROSE}</p><div class=comments><article><p>I, a reader, think otherwise. This is why.</p></article></div></article>",
    f"<aside><article><p>Read this other story, it is really good. You will like it.</p></article></aside><main><p>{PROSE}</p></main>",
])
def test_legal_pages(html):
    assert M.main_text(html) == PROSE


def test_headline_in_a_named_header():
    for html in (f"<article><header class='entry-header'><h1>Headline</h1></header><p>{PROSE}</p></article>", f"<article><div class='post-header'><h1>Headline</h1></div><p>{PROSE}</p></article>"):
        assert M.main_text(html) == f"Headline {PROSE}"
    assert M.main_text(f"<div class='page-header'><a href=/>Site</a></div><article><p>{PROSE}</p></article>") == PROSE


def test_deep_nesting_takes_linear_time():
    import time

    def seconds(n):
        t0 = time.perf_counter()
        M.parsed("".join(f"<div>word {k} " for k in range(n)) + "</section>" * n)
        return time.perf_counter() - t0

    seconds(500)
    assert seconds(16_000) < 3
    t0 = time.perf_counter()
    M.main_text("<div>x " * 8000)
    assert time.perf_counter() - t0 < 10


def test_text_without_marks():
    long = "This is a long paragraph of plain prose, which goes on for a while and has several clauses. It even has a second sentence."
    html = f"<div><a href=1>Home</a> <a href=2>About</a></div><div><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href=3>Privacy</a></div>"
    assert M.main_text(html) == f"{long} Short one. {long}"


def brute_cut(n, edges):
    best = None
    for mask in range(1 << n):
        side = [mask >> i & 1 for i in range(n)] + [1, 0]
        cost = sum(c for a, b, c in edges if side[a] and not side[b])
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def test_minimum_cut_against_brute_force():
    import random

    for seed in range(30):
        rnd, n = random.Random(seed), 7
        edges = [(n, i, rnd.random()) for i in range(n)] + [(i, n + 1, rnd.random()) for i in range(n)]
        both = [(rnd.randrange(n), rnd.randrange(n), rnd.random()) for _ in range(12)]
        edges += [(a, b, c) for a, b, c in both if a != b] + [(b, a, c) for a, b, c in both if a != b]
        graph = M.FlowGraph(n + 2)
        for a, b, c in edges:
            graph.add(a, b, c)
        side = graph.content(n, n + 1)
        assert side[n] and not side[n + 1]
        assert sum(c for a, b, c in edges if side[a] and not side[b]) == pytest.approx(brute_cut(n, edges))


ODD_PAGES = [None, "", "<", "<p", "<!-- x", "&am", "<script>x", "<p>" * 2000 + "deep", "<div>" * 500 + "deep", "<b>" * 300 + "x</article></b></p>", "a" * 20000, "<article>" + "<p>One sentence here.</p>" * 2000 + "</article>"]


def test_odd_pages(spark):
    rows = [(i, f"http://x/{i}", h, "p", "t") for i, h in enumerate(ODD_PAGES)] + [(None, None, None, None, None), (11, "u", ODD_PAGES[11], "", "")]
    got = M.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[11] == " ".join(["One sentence here."] * 2000)
    assert M.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_whole_articles_of_the_pages(spark):
    import html as entities
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert M.main_text(r.html) == want


def test_roundtrip(spark, monkeypatch):
    monkeypatch.setattr(W, "PACKAGE_BYTES", 700)
    bodies = ["<p>one</p>", "<p>two</p>", "<p>one</p>", "", None, "é" * 300, "<p>one</p>", "x" * 5000, "WARC/1.1\r\n\r\n"]
    rows = [(i, f"http://x/é {i}\r\nA: b", h, "p", "t") for i, h in enumerate(bodies)] + [(-5, None, "neg", "", ""), (None, "u", "<p>one</p>", "", ""), (None, "u", "only", "", ""), (7, "u", "x" * 5000, "", "")]
    got = sorted((tuple(r) for r in W.roundtrip(spark.createDataFrame(rows, PAGES).repartition(2)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=repr)
    newest = {}
    for i, _, h, *_ in rows:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        raw, top = (h or "").encode(), newest.get(h or "")
        revisit = top is not None and (i is None or i < top)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, None if revisit else bytearray(raw)))
    assert got == sorted(want, key=repr)
    few = {r.page_id: r.record_type for r in W.roundtrip(spark.createDataFrame(rows[:4], PAGES), min_bytes=100).collect()}
    assert set(few.values()) == {"response"}
    assert W.roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def opened(data):
    return pa.BufferReader(data)


def test_packages_are_zip_files():
    data = W.zip_bytes([("a.txt", b"one"), ("b/ü", b""), ("c", b"x" * 70000)])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {"a.txt": b"one", "b/ü": b"", "c": b"x" * 70000}
    found = W.directory(opened(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"a.txt": b"one", "b/ü": b"", "c": b"x" * 70000}


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"plain")
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"wide")
        z.comment = b"PK not a header"
    data = out.getvalue()
    assert {k: data[a : a + n] for k, (a, n) in W.directory(opened(data)).items()} == {"a": b"plain", "b": b"wide"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"plain" * 99)
    with pytest.raises(ValueError, match="compressed"):
        W.directory(opened(out.getvalue()))
    for broken in (b"", b"PK", data[:-30], W.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, 46, 0, 0)):
        with pytest.raises((ValueError, struct.error)):
            W.directory(opened(broken))


def test_a_changed_record_is_an_error(spark):
    root = new_path(spark, "broken")
    pages = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, payload string").selectExpr("page_id", "url", "cast(payload as binary) payload", "cast(null as long) refers_to")
    path = W.write_archives(pages, root).first().path
    place, _ = fs.FileSystem.from_uri(root)
    raw = place.open_input_file(path).read()
    at, length = W.directory(opened(raw))[W.DATA]
    record = gzip.compress(gzip.decompress(raw[at : at + length]).replace(b"\r\n\r\nbody", b"\r\n\r\nb0dy"), 1, mtime=0)
    index = '{"offset": 0, "length": %d, "filename": "%s", "record": ""}' % (len(record), W.DATA)
    with place.open_output_stream(path) as out:
        out.write(W.zip_bytes([(W.DATA, record), (W.INDEX, index.encode())]))
    with pytest.raises(Exception, match="another digest"):
        W.read_archives(spark.createDataFrame([(path,)], "path string"), root).collect()
