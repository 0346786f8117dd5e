from __future__ import annotations

import base64
import hashlib
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from textloom.llm import warc

ROWS = [
    (1, "http://a.example/x/", "<html><head><title>A &amp; B</title></head><body><p>One <b>two</b><br>three</p><script>var t='</p>'</script><!-- no --><a href='../y?a=1&amp;b=2'>l</a><a href=#top>t</a></body></html>"),
    (1, "http://a.example/x/", "<p>other"),
    (2, None, None),
    (2, None, None),
    (None, "not an address [", "<a href='http://[bad'>x</a>&lt;p&gt; 日本" + "x " * 50_000),
    (3, "http://b.example/\r\nX: y", ""),
]


def rows(spark):
    return spark.createDataFrame([(*r, None) for r in ROWS], "page_id long, url string, html string, kind string")


def test_records_read_back_and_link_to_their_source(spark):
    got = warc.derivatives(rows(spark), sources=True).collect()
    assert len(got) == 3 * len(ROWS)
    data = [bytes(r.record) for r in got]
    for file in (b"".join(data), b"".join(next(warc.parse(d)).member() for d in data)):
        records = list(warc.parse(file))
        assert [r.kind for r in records] == [r.kind for r in got]
        of = {r.headers["WARC-Record-ID"]: r for r in records if r.kind == "response"}
        for r, row in zip(records, got):
            assert r.headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode() == row.block_digest
            assert len(r.block) == row.n_bytes
            if r.kind != "response":
                source = of[r.headers["WARC-Refers-To"]]
                assert source.headers.get("WARC-Target-URI") == r.headers.get("WARC-Target-URI") == r.headers.get("WARC-Refers-To-Target-URI") == row.target_uri
                assert source.headers["WARC-Date"] == r.headers["WARC-Date"]
                assert source.headers["WARC-Payload-Digest"] == row.source_payload_digest
            if r.kind == "metadata":
                assert f"source-payload-digest: {source.headers['WARC-Payload-Digest']}\r\n".encode() in r.block
                assert b"http-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
    assert len({r.record_id for r in got}) == 3 * (len(ROWS) - 1)  # one row repeats another


def test_metadata_and_text(spark):
    meta, text = warc.derive(warc.response("1", ROWS[0][1], ROWS[0][2]))
    assert b"title: A & B\r\n" in meta.block and b"outlink: http://a.example/y?a=1&b=2\r\n" in meta.block and meta.block.count(b"outlink") == 1
    assert text.block.decode() == "One two\nthree\nl" + "t"
    assert warc.plain_text("&lt;p&gt; a") == "<p> a"


class Words(HTMLParser):
    """An independent way to a page's words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head")
        self.out.append(" " if tag in ("p", "br", "li", "ul", "h1", "div", "nav", "article", "td", "tr", "table", "footer", "section") else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head")
        self.out.append(" " if tag in ("p", "br", "li", "ul", "h1", "div", "nav", "article", "td", "tr", "table", "footer", "section") else "")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_pages_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for p in pages:
        w = Words()
        w.feed(p.html)
        assert warc.plain_text(p.html).split() == "".join(w.out).split()


class Anchors(HTMLParser):
    """An independent way to the title and the anchors' targets."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.to, self.named, self.inside = [], [], False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title"
        if tag == "a" and (to := dict(attrs).get("href")):
            self.to.append(to.strip())

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.named.append(data)


def test_titles_and_links_against_a_parser(spark):
    for p in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        w, own = Anchors(), warc.Page(p.html)
        w.feed(p.html)
        assert (own.title() or "") == " ".join("".join(w.named).split())
        assert own.links(p.url) == list(dict.fromkeys(" ".join(urljoin(p.url, x).split()) for x in w.to if x and not x.startswith("#")))


def test_hostile_pages_take_time_in_proportion():
    """Five megabytes each of what is never closed."""
    for part in ("<script>x ", "<a x ", "<!-- a ", "<title>b ", "<a href='"):
        page = part * (5_000_000 // len(part))
        began = time.time()
        own = warc.Page(page)
        own.text(), own.title(), own.links("http://a.example/")
        assert time.time() - began < 20, part
    assert warc.plain_text("<script>a <b>c</b> <!-- d") == "a c <!-- d"
    assert warc.plain_text("a<script>b</script>c<!-- <p> -->d <x") == "a cd <x"


def test_dates_and_warc_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "http://a.example/", "<p>a", "2024-05-06T07:08:09Z"), (2, None, "<title>t</title>b", None)], "page_id long, url string, html string, at string")
    got = warc.derivatives(docs, date_col="at", sources=True).orderBy("page_id").collect()
    stamps = [next(warc.parse(bytes(r.record))).headers["WARC-Date"] for r in got]
    assert stamps == ["2024-05-06T07:08:09Z"] * 3 + [warc.NO_DATE] * 3
    same = warc.derivatives(docs.withColumn("at", F.to_timestamp("at")), date_col="at", sources=True).orderBy("page_id").collect()
    assert [bytes(r.record) for r in same] == [bytes(r.record) for r in got]
    data = [bytes(r.record) for r in got if r.kind == "response"]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(next(warc.parse(d)).member() for d in data))
    (tmp_path / "c.warc").write_bytes(b"")
    read = warc.read(spark, f"file://{tmp_path}")
    rows = read.orderBy("path", "at").collect()
    assert [(r.at, r.kind, bytes(r.record)) for r in rows] == [(n, "response", d) for n, d in enumerate(data)] * 2
    made = warc.derive_records(read).collect()
    want = [bytes(r.record) for r in got if r.kind != "response"]
    assert sorted(bytes(r.record) for r in made) == sorted(want * 2)
    assert warc.derive_records(read.limit(0)).count() == 0


def test_other_charsets_and_no_http_head():
    r = warc.Record("response", {"WARC-Record-ID": "<urn:x>"}, b"HTTP/1.0 404 No\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9")
    assert warc.derive(r)[1].block == "é".encode()
    assert warc.derive(warc.Record("response", {"WARC-Record-ID": "<urn:x>"}, b"plain"))[1].block == b"plain"


def test_empty(spark):
    assert warc.derivatives(rows(spark).limit(0)).count() == 0
