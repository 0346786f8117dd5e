"""WARC derivatives: from each response, a metadata record and a plain-text conversion record that refer back to it.

Records are WARC/1.1. A derived record keeps the source's target URI, date, IP address and info identifiers, names the
source in WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date, and carries digests of its own block; the
metadata record also lists the source's digests, HTTP status and headers, title and links. Each row makes its records
alone, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm.common import map_rows

VERSION = "WARC/1.1"
#: The capture date of pages that come without one.
NO_DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "derivatives.invalid")
#: Headers that a derived record takes over as they are.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID")
#: Elements whose content is no text, and elements that begin and end a line.
HIDDEN = ("script", "style", "head", "noscript", "template", "svg")
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: A tag with its name, or the beginning of a comment. It is looked for up to the page's last `>`, so every tag ends.
_TAG = re.compile(r"<(?:!--|([/!?]?[a-zA-Z][^\s/>]*)[^>]*>)")
_CLOSING = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*HIDDEN, "title")}
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Ahead:
    """Where something stands next at or after a place; places asked for never go back, so all is looked at once."""

    def __init__(self, find: Callable[[int], tuple[int, int] | None]):
        self.find, self.at = find, (-1, -1)

    def __call__(self, place: int) -> tuple[int, int] | None:
        if self.at is not None and self.at[0] < place:
            self.at = self.find(place)
        return self.at


class Page:
    """The text, title and link targets of an HTML page, read in one forward pass that takes time in proportion to the
    page's length, whatever is left open in it.

    A tag ends at the next `>`; without one, what looks like a tag is text. Comments and hidden elements go with what is
    in them, if they are closed. The first title counts, and so do links and titles in hidden elements.
    """

    def __init__(self, source: str):
        self.parts, self.targets, self.heading = [], [], None
        plain = lambda x: lambda i: (j, j + len(x)) if (j := source.find(x, i)) >= 0 else None
        by = lambda p: lambda i: m.span() if (m := p.search(source, i)) else None
        comment = _Ahead(plain("-->"))
        closing = {x: _Ahead(by(p)) for x, p in _CLOSING.items()}
        at, begin, last, add = 0, 0, source.rfind(">") + 1, self.parts.append  # text counts from `begin` on
        while m := _TAG.search(source, at, last):
            here, at = m.span()
            seen = here >= begin
            if here > begin:
                add(source[begin:here])
            if m[1] is None:
                close = comment(at)
                if close:
                    at = close[1]
                if seen:
                    begin = at if close else here
                continue
            kind = m[1].lower()
            if kind == "a" and (to := _HREF.search(source, here + 2, at)):
                self.targets.append(next(x for x in to.groups() if x is not None))
            elif kind == "title" and self.heading is None and (close := closing[kind](at)):
                self.heading = source[at : close[0]]
            if not seen:
                continue
            begin = at
            if kind in HIDDEN and (close := closing[kind](at)):
                begin = close[1]
                add(" ")
                if kind not in ("head", "noscript", "template"):  # nothing is read in these
                    at = begin
            elif kind.removeprefix("/") in BLOCKS:
                add("\n")
        if begin < len(source):
            add(source[begin:])

    def text(self) -> str:
        """A line for each block, one space between words, entities decoded."""
        return _LINES.sub("\n", _SPACE.sub(" ", html.unescape("".join(self.parts)))).strip()

    def title(self) -> str | None:
        return " ".join(html.unescape(self.heading).split()) if self.heading is not None else None

    def links(self, base: str | None) -> list[str]:
        """Targets of anchors against the page's address, each once, in order."""
        out = {}
        for x in self.targets:
            to = html.unescape(x).strip()
            if to and not to.startswith("#"):
                try:
                    out[" ".join(urljoin(base or "", to).split())] = None
                except ValueError:  # an address that isn't one
                    continue
        return list(out)


def plain_text(source: str) -> str:
    return Page(source).text()


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def bytes(self) -> bytes:
        head = {"WARC-Type": self.kind} | self.headers | {"Content-Length": str(len(self.block))}
        return f"{VERSION}\r\n{''.join(f'{k}: {v}\r\n' for k, v in head.items())}\r\n".encode() + self.block + b"\r\n\r\n"

    def member(self) -> bytes:
        """As a gzip member of its own; members one after another are a WARC file."""
        return gzip.compress(self.bytes(), 6, mtime=0)


def parse(data: bytes) -> Iterator[Record]:
    """Records of an uncompressed WARC file, or of one whose gzip members each hold a record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        lower = {k.lower(): k for k in headers}
        size = int(headers.pop(lower["content-length"]))
        yield Record(headers.pop(lower["warc-type"]), headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)], payload


def charset(headers: list[tuple[str, str]]) -> str:
    for k, v in headers:
        if k.lower() == "content-type" and (m := re.search(r"charset\s*=\s*\"?([\w.:-]+)", v, re.I)):
            return m[1]
    return "utf-8"


def response(key: str, url: str | None, source: str | None, date: str | None = None) -> Record:
    """A response record of a stored page. Equal pages under equal keys have equal identifiers."""
    body = (source or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    own = uuid.uuid5(NAMESPACE, f"{key}\n{url}\n{hashlib.sha256(body).hexdigest()}")
    headers = {"WARC-Record-ID": f"<urn:uuid:{own}>"}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]+", "", url)
    headers |= {"WARC-Date": date or NO_DATE, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(body)}
    return Record("response", headers, block)


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata record and the conversion record of a response."""
    of = source.headers["WARC-Record-ID"]
    status, fields, payload = http(source.block)
    try:
        text = payload.decode(charset(fields), "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    url = source.headers.get("WARC-Target-URI")
    meta = [("source-block-digest", source.headers.get("WARC-Block-Digest", digest(source.block))), ("source-payload-digest", source.headers.get("WARC-Payload-Digest", digest(payload)))]
    meta += [("http-status", status)] * bool(status) + [("http-header", f"{k}: {v}") for k, v in fields]
    page = Page(text)
    meta += [("title", x) for x in [page.title()] if x] + [("outlink", x) for x in page.links(url)]
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in meta).encode()), ("conversion", "text/plain; charset=utf-8", page.text().encode())):
        headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, kind + of)}>", "WARC-Refers-To": of}
        headers |= {k: source.headers[k] for k in KEPT if k in source.headers}
        if url is not None:
            headers["WARC-Refers-To-Target-URI"] = url
        if "WARC-Date" in source.headers:
            headers["WARC-Refers-To-Date"] = source.headers["WARC-Date"]
        headers |= {"Content-Type": mime, "WARC-Block-Digest": digest(block)}
        out.append(Record(kind, headers, block))
    return out[0], out[1]


_COLUMNS = "page_id long,kind string,record_id string,refers_to string,target_uri string,source_payload_digest string,block_digest string,n_bytes long,record binary"


def _rows_of(key: int | None, source: Record, sources: bool) -> Iterator[tuple]:
    for r in (*([source] if sources else []), *derive(source)):
        h = r.headers
        payload = source.headers.get("WARC-Payload-Digest") or digest(http(source.block)[2])
        yield (key, r.kind, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), payload, h.get("WARC-Block-Digest") or digest(r.block), len(r.block), r.bytes())


def _table(rows: list[tuple]) -> dict[str, list]:
    names = [c.split()[0] for c in _COLUMNS.split(",")]
    return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))


def derivatives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, sources: bool = False) -> DataFrame:
    """page_id, kind, record_id, refers_to, target_uri, source_payload_digest, block_digest, n_bytes (of the block),
    record (its bytes): a metadata and a conversion row for each page, and with `sources` the response too.

    date_col is a timestamp or text of the form 2024-01-31T12:00:00Z; a page without one is dated NO_DATE. A null page
    is an empty payload, and a null address leaves the URI headers out. Rows that repeat give records with equal
    identifiers, each; an empty table gives none. Pages of any length are read whole, in one pass. Only the named
    columns are read.
    """

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            yield _table([r for key, url, page, date in zip(x["page_id"], x["url"], x["html"], x["date"], strict=True) for r in _rows_of(key, response(str(key), url, page, date), sources)])

    date = F.lit(None) if date_col is None else F.col(date_col)
    if date_col is not None and not isinstance(pages.schema[date_col].dataType, StringType):
        date = F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), date.cast("string").alias("date"))
    return map_rows(own, run, _COLUMNS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, at (the record's number in its file), kind, record_id, target_uri, record: the records of WARC files, each
    file plain or of gzip members. Any path that Spark reads will do. A file is read by one task and has to fit in
    its memory twice; Spark's limit for a file is 2 GB. A file that holds something else fails the query."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            for name, content in zip(x["path"], x["content"], strict=True):
                part: list[tuple] = []
                for n, r in enumerate(parse(content)):
                    part.append((name, n, r.kind, r.headers.get("WARC-Record-ID"), r.headers.get("WARC-Target-URI"), r.bytes()))
                    if len(part) == 256:
                        yield dict(zip(_READ, zip(*part, strict=True), strict=True))
                        part = []
                yield dict(zip(_READ, zip(*part, strict=True) if part else [[]] * len(_READ), strict=True))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_rows(files, run, "path string,at long,kind string,record_id string,target_uri string,record binary")


_READ = ("path", "at", "kind", "record_id", "target_uri", "record")


def derive_records(records: DataFrame, *, record_col: str = "record") -> DataFrame:
    """The columns of derivatives() for WARC records as read() gives them: a metadata and a conversion row for each
    response, page_id null. Records of other kinds and nulls give nothing; a response without an identifier gets one
    from its bytes. Rows that repeat give equal records each; an empty table gives none."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            rows = []
            for data in x["record"]:
                for r in parse(data or b""):
                    if r.kind == "response":
                        r.headers.setdefault("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, hashlib.sha256(data).hexdigest())}>")
                        rows += _rows_of(None, r, False)
            yield _table(rows)

    return map_rows(records.select(F.col(record_col).alias("record")), run, _COLUMNS)
