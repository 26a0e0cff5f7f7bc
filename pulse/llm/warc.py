"""Derived archive records: every response gives a linked metadata and a plain-text conversion record.

Record ids are name-based, so a repeated run gives the same ids. ``WARC-Refers-To`` of both derivatives
names the response, target URI, date and payload digest of the source are carried over, and each record has
its own block digest. A null body counts as empty; a null url gives records without a target URI. Rows
that repeat id, url and body give the same records again. Columns other than these are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
#: Elements whose content is no text, and those that end a line.
SILENT = frozenset("script style noscript template".split())
BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer title body head".split())
TAG = re.compile(r"<[a-zA-Z/!?]")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?![\w-])")
CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in SILENT}
HREF = re.compile(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""")
BLANKS = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page_id: object, url: str | None, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {url} {payload}')}>"


def scan(html: str) -> tuple[str, list[str]]:
    """Text of a page and the targets of its links, in one pass from tag to tag.

    Silent elements, comments and tags are removed, block ends become line ends, entities are resolved. A comment or
    silent element that is never closed loses its tag only, and what no sign ends is text; each search for
    an end is made once where it fails, so the time is in proportion to the length.
    """
    out, links, at, unclosed = [], [], 0, set()
    while (opens := html.find("<", at)) >= 0:
        out.append(html[at:opens])
        if html.startswith("<!--", opens) and "!" not in unclosed:
            end = html.find("-->", opens + 4)
            if end >= 0:
                out.append(" ")
                at = end + 3
                continue
            unclosed.add("!")
        if not TAG.match(html, opens):
            out.append("<")
            at = opens + 1
            continue
        end = html.find(">", opens)
        if end < 0:
            at = opens
            break
        name = NAME.match(html, opens, end)
        kind = name[1].lower() if name else ""
        at = end + 1
        if kind in SILENT and html[opens + 1] != "/" and kind not in unclosed:
            close = CLOSE[kind].search(html, at)
            if close:
                out.append(" ")
                at = close.end()
                continue
            unclosed.add(kind)
        if kind in BREAK:
            out.append("\n")
        elif kind == "a" and (link := HREF.search(html, opens, end)):
            links.append(link[1])
    out.append(html[at:])
    text = entities.unescape("".join(out))
    lines = (BLANKS.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line), links


def plain_text(html: str) -> str:
    return scan(html)[0]


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One archive record in its file form."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def derive(page_id: object, url: str | None, html: str | None) -> list[tuple[str, str, bytes]]:
    """(type, record id, record) of the response and its two derivatives."""
    body = (html or "").encode()
    target = re.sub(r"[\r\n]", "", url) if url is not None else None
    payload = digest(body)
    source = record_id("response", page_id, url, payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    shared = {"WARC-Target-URI": target, "WARC-Date": DATE}
    plain, links = scan(html or "")
    text = plain.encode()
    fields = "".join(
        [f"sourceDigest: {payload}\r\n", f"contentLength: {len(body)}\r\n", *(f"outlink: {re.sub(r'[\r\n]', '', x)}\r\n" for x in links)]
    ).encode()
    made = [("response", "application/http; msgtype=response", http), ("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)]
    out = []
    for kind, media, block in made:
        own = source if kind == "response" else record_id(kind, page_id, url, payload)
        headers = {"WARC-Type": kind, "WARC-Record-ID": own, **shared, "Content-Type": media, "WARC-Block-Digest": digest(block)}
        if kind == "response":
            headers["WARC-Payload-Digest"] = payload
        else:
            headers |= {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": DATE}
        if kind == "conversion":
            headers["WARC-Source-Payload-Digest"] = payload
        out.append((kind, own, record(headers, block)))
    return out


def derivatives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Three rows per page: its response, metadata and conversion records."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, urls, bodies = (part.column(i).to_pylist() for i in range(3))
                rows = [(p, u, *r) for p, u, h in zip(ids, urls, bodies) for r in derive(p, u, h)]
                cols = list(zip(*rows))
                kinds = [part.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "warc_type", "record_id", "record"])

    columns = pages.select(F.col(page_id), F.col(url), F.col(html))
    return columns.mapInArrow(run, f"page_id {kind}, url string, warc_type string, record_id string, record binary")
