r"""WARC derivative builder.

Responses become two linked derivatives each: a `metadata` record (JSON: all source headers in order, title, links,
digests) and a `conversion` record (plain text).  Both name their response in WARC-Refers-To, keep its target URI, date
and digests, and carry digests of their own blocks.  `responses` makes response records of raw pages; `derive` takes any
table of serialised records; both are real WARC/1.1 bytes that `parse` reads back.

Pages are read by one scanner that goes from tag to tag and never back, so any markup takes time in proportion to its
length.  As in browsers, a comment, tag, script or title that is never closed reaches to the end of the page.

Defined cases: a null page body is an empty payload, a null url an empty target; text of a page without a body tag is
that of the whole page; a body is decoded by its transfer and content encoding and its charset (header, byte order mark,
meta element, else UTF-8; bytes that do not fit become U+FFFD); records of other types give nothing; null and malformed
records, and bodies in an unknown encoding, give one row with `error` alone; records of repeated rows are repeated with
equal ids, so there are no ties to break; very long pages are handled alone, whole; an empty table gives no records; only
the named columns are read, so other columns cannot clash."""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import parts, small_batches

DATE = "2024-01-01T00:00:00Z"
# Elements whose content is not text, whose content is plain characters, that break lines, that link.
_HIDDEN = frozenset("script style noscript template".split())
_PLAIN = frozenset("title textarea".split())
_BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav blockquote pre title td th hr form main aside".split())
_LINKING = frozenset("a area link img script iframe".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in (*_HIDDEN, *_PLAIN)}
_STOP = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]{1,40})", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]{1,40})", re.I)
_NUMBER = re.compile(r"&#([xX]?)([0-9a-fA-F]{8,})")
_BLANK = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    """A repeatable identifier: equal inputs give equal records, also when a task is run again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + chr(10) + chr(10).join(parts))}>"


def record(headers: list, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def fields(lines: list) -> list:
    """(name, value) of header lines, in order, repeated names included; a line that starts with a blank goes on with the
    value before it."""
    out: list = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif colon:
            out.append((name.strip(), value.strip()))
    return out


def first(headers: list, name: str) -> str | None:
    """The first value of a header; names are case-blind."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse(data: bytes) -> tuple[list, bytes]:
    """(headers, block) of a serialised record; ValueError if it is none."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = fields(lines)
    size = first(headers, "Content-Length") or ""
    if not version.startswith("WARC/") or not cut:
        raise ValueError("not a WARC record")
    if not (size.isascii() and size.isdigit() and len(size) < 19) or int(size) > len(rest):
        raise ValueError("no block of the stated length")
    return headers, rest[: int(size)]


def response(key: str, url: str, body: bytes, date: str = DATE) -> bytes:
    """A response record that holds an HTTP message with this body."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, http)


def unescape(text: str) -> str:
    """All character references; numbers too long for a code point stand for U+FFFD, however many digits they have."""

    def short(m: re.Match) -> str:
        digits = m[2].lstrip("0") or "0"
        return f"&#{m[1]}{digits}" if len(digits) < 8 else "&#x110000"

    return html.unescape(_NUMBER.sub(short, text) if "&#" in text else text)


def _tag_end(page: str, at: int) -> int:
    """The place of the `>` that closes a tag, outside quoted values; the page's length if there is none."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    inside = page[at:end]
    if '"' not in inside and "'" not in inside:
        return end
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = _SPACE.match(page, m.end()).end()
        if (quote := page[at : at + 1]) and quote in "\"'":
            at = page.find(quote, at + 1) + 1
            if not at:
                break
    return len(page)


class Page:
    """title, links and text of a page, read in one pass."""

    def __init__(self, page: str):
        self.title, self.links = None, []
        out, last, in_body = [], None, False
        i = 0
        while (j := page.find("<", i)) >= 0:
            out.append(page[i:j])
            if page.startswith("<!--", j):
                end = page.find("-->", j + 2)
                i = len(page) if end < 0 else end + 3
                out.append(" ")
                continue
            m = _NAME.match(page, j + 1)
            if not m:
                if page[j + 1 : j + 2] in ("!", "?", "/"):
                    end = page.find(">", j)
                    i = len(page) if end < 0 else end + 1
                else:
                    out.append("<")
                    i = j + 1
                continue
            name, opens = m[1].lower(), page[j + 1] != "/"
            end = _tag_end(page, m.end())
            i = min(end + 1, len(page))
            if end == len(page):
                break
            if name in _BREAKS:
                out.append("\n")
            if name == "body":
                if opens and not in_body:
                    out.clear()
                    in_body = True
                elif not opens:
                    last = len(out)
            if not opens:
                continue
            if name in _LINKING:
                for a in _ATTRIBUTE.finditer(page, m.end(), end):
                    if (kind := a[1].lower()) in ("href", "src"):
                        self.links.append({"path": f"{name.upper()}@/{kind}", "url": unescape(a[2].strip("\"'"))})
            if name in _HIDDEN or name in _PLAIN:
                found = _CLOSE[name].search(page, i)
                content = page[i : found.start() if found else len(page)]
                if name == "title" and self.title is None:
                    self.title = unescape(content).strip()
                out.append(content if name in _PLAIN else " ")
                i += len(content)
        out.append(page[i:])
        text = unescape("".join(out[:last] if in_body and last is not None else out))
        self.text = _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments go, block tags break lines, entities are resolved."""
    return Page(page).text


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        try:
            n = int(size[:16], 16)
        except ValueError:
            break
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    raise ValueError("broken chunks")


def _inflated(body: bytes, kind: str) -> bytes:
    if kind in ("", "identity"):
        return body
    if kind not in ("gzip", "x-gzip", "deflate"):
        raise ValueError(f"content encoding {kind}")
    try:
        return zlib.decompress(body, 47)
    except zlib.error:
        if kind != "deflate":
            raise ValueError("broken gzip body") from None
    try:
        return zlib.decompress(body, -15)
    except zlib.error:
        raise ValueError("broken deflate body") from None


def decoded(headers: list, body: bytes) -> str:
    """The text of a body by its encodings and its charset."""
    if "chunked" in (first(headers, "Transfer-Encoding") or "").lower():
        body = _dechunked(body)
    for kind in reversed((first(headers, "Content-Encoding") or "").lower().split(",")):
        body = _inflated(body, kind.strip())
    named = _CHARSET.search(first(headers, "Content-Type") or "")
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
    marked = next((c for mark, c in marks if body.startswith(mark)), None)
    meta = None if named or marked else _META.search(body[:1024])
    charset = marked or (named[1] if named else meta[1].decode() if meta else "utf-8")
    try:
        return body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def derivatives(data: bytes | None) -> list[tuple[list, bytes]]:
    """(headers, block) of the metadata and the conversion record of a response; none of another record; ValueError for
    what is no record."""
    if data is None:
        raise ValueError("null record")
    source, http = parse(data)
    if (first(source, "WARC-Type") or "").lower() != "response":
        return []
    if not (refers := first(source, "WARC-Record-ID")):
        raise ValueError("no record id")
    head, _, body = http.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    sent = fields(lines)
    page = Page(decoded(sent, body))
    uri, date = first(source, "WARC-Target-URI") or "", first(source, "WARC-Date")
    payload = first(source, "WARC-Payload-Digest") or digest(body)
    envelope = {
        "WARC-Header-Metadata": source, "Actual-Content-Length": len(http), "Block-Digest": first(source, "WARC-Block-Digest") or digest(http), "Payload-Digest": payload,
        "HTTP-Response-Metadata": {"Status": status, "Headers": sent, "HTML-Metadata": {"Title": page.title, "Links": page.links}},
    }
    meta = json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    out = []
    for kind, block, content in (("metadata", meta, "application/json"), ("conversion", page.text.encode("utf-8", "replace"), "text/plain; charset=utf-8")):
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, refers, digest(block))), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", content),
        ]
        out.append((headers, block))
    ids = [first(h, "WARC-Record-ID") for h, _ in out]
    out[0][0].append(("WARC-Concurrent-To", ids[1]))
    out[1][0].append(("WARC-Concurrent-To", ids[0]))
    return out


def responses(pages: DataFrame, url: str = "url", body: str = "html", key: str = "page_id") -> DataFrame:
    """(key, warc): a response record of each page."""
    small_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, urls = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, bodies in parts(b, body):
                made = [response(str(k), u or "", x or b"") for k, u, x in zip(keys[i:j], urls[i:j], bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(made, pa.binary())], names=[key, "warc"])

    return pages.select(key, url, body).mapInArrow(run, f"{key} {kind}, warc binary")


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response record: key, the linking headers, the record's bytes and its block.  A record that
    cannot be read gives one row with its key and `error`."""
    kind = records.schema[key].dataType.simpleString()
    linking = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Source-Payload-Digest", "WARC-Block-Digest")
    names = [key, "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_payload_digest", "block_digest", "block_length", "block", "warc", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, records_ in parts(b, "warc"):
                at, rows = [], []
                for k, data in enumerate(records_, i):
                    try:
                        made = [(*(first(h, x) for x in linking), len(block), block, record(h, block), None) for h, block in derivatives(data)]
                    except ValueError as e:
                        made = [(*[None] * 10, str(e))]
                    at += [k] * len(made)
                    rows += made
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.string()] * 7, pa.int64(), pa.binary(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    schema = f"{key} {kind}, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_payload_digest string, block_digest string, block_length bigint, block binary, warc binary, error string"
    return records.select(key, "warc").mapInArrow(run, schema)


def op9(pages: DataFrame) -> DataFrame:
    """Every derivative with its links and digests; a crc32 of the record's bytes stands for them."""
    made = derive(responses(pages)).where(F.col("error").isNull())
    return made.selectExpr("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_payload_digest", "block_digest", "block_length", "crc32(warc) AS record_crc32", "length(warc) AS record_length")
