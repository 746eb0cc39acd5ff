"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

A response record is parsed from its bytes. Its derivatives refer to it by record id, keep its target, date
and payload digest, and carry digests of their own blocks. The metadata block is a JSON envelope with the
record's and the HTTP headers, title and links; the conversion block is the page's text.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import map_arrow

VERSION = "WARC/1.1"
#: Date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Elements whose content isn't text, and elements that end a line.
HIDDEN = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "header", "footer", "nav", "title", "head", "body", "html", "blockquote", "pre"}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"[^\s>]+")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A urn:uuid fixed by its parts."""
    h = bytearray(hashlib.sha256("\0".join(parts).encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x80, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind} | headers | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return (VERSION + "\r\n" + "".join(f"{k}: {_plain(v)}\r\n" for k, v in lines.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _plain(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def response(page: str, url: str, body: bytes, date: str = NO_DATE, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A response record around an HTML body; its id is fixed by page, URL and body."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = {"WARC-Record-ID": record_id("response", page, url, digest(body)), "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body)}
    return record("response", headers, block)


def parse_headers(head: bytes) -> tuple[str, dict[str, str]]:
    """(first line, headers); folded lines belong to the header before, later equal names win."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            out[name] = value
    return first, out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, headers = parse_headers(head)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return headers, rest[: int(headers["Content-Length"])]


class _Search:
    """Forward searches in a page that must not cost its length again and again: what was not found isn't sought again."""

    def __init__(self, page: str) -> None:
        self.page, self.lower = page, page.lower() if page.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), page)
        self.missing: set[str] = set()

    def find(self, what: str, start: int) -> int:
        if what in self.missing:
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.missing.add(what)
        return at

    def closing(self, name: str, start: int) -> tuple[int, int]:
        """(begin, end) of the next closing tag of that name, or (-1, -1)."""
        mark = "</" + name
        while mark not in self.missing:
            at = self.lower.find(mark, start)
            if at < 0:
                self.missing.add(mark)
                break
            end = at + len(mark)
            while end < len(self.page) and self.page[end].isspace():
                end += 1
            if self.page[end : end + 1] == ">":
                return at, end + 1
            start = end
        return -1, -1


def scan(page: str) -> tuple[str, str | None, list[str]]:
    """(text with its line breaks, title, links) of an HTML page, in one pass.

    A tag ends at the next ``>``. Comments and the content of ``HIDDEN`` elements are left out; a hidden element that
    isn't closed is a mere tag, a comment that isn't closed hides the rest of the page.
    """
    find = _Search(page)
    out: list[str] = []
    links: list[str] = []
    title = None
    at = 0
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = find.find("-->", lt + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        if not (page[lt + 1 : lt + 2] in ("/", "!", "?") or (page[lt + 1 : lt + 2].isascii() and page[lt + 1 : lt + 2].isalpha())):
            out.append("<")
            at = lt + 1
            continue
        gt = find.find(">", lt + 1)
        if gt < 0:
            at = lt
            break
        at = gt + 1
        tag = _NAME.match(page, lt + 1, gt)
        name = tag[1].lower() if tag else ""
        opening = page[lt + 1] != "/"
        if name in HIDDEN and opening:
            end = find.closing(name, at)[1]
            if end >= 0:
                out.append(" ")
                at = end
        elif name in BREAKS:
            out.append("\n")
            if name == "title" and opening and title is None:
                end = find.closing(name, at)[0]
                title = page[at:end] if end >= 0 else None
        elif name == "a" and opening and (href := _HREF.search(page, lt, gt)):
            mark, begin = page[href.end()], href.end()
            end = find.find(mark, begin + 1) if mark in "\"'" else -1
            value = page[begin + 1 : end] if end >= 0 else (found[0] if (found := _VALUE.match(page, begin, gt)) else None)
            if value is not None:
                links.append(html.unescape(value))
    out.append(page[at:])
    return "".join(out), title, links


def tidy(text: str) -> str:
    """Character references resolved, runs of white space made one, blank lines left out."""
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text))).strip()


def derive(data: bytes) -> list[tuple[str, str, str, str, str, str, bytes]]:
    """(type, record id, refers to, target, content type, block digest, record) of the two derivatives."""
    source, block = parse(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    status, http = parse_headers(head)
    page = payload.decode("utf-8", "replace")
    text, title, links = scan(page)
    origin = {k: source[k] for k in ("WARC-Target-URI", "WARC-Date") if k in source}
    linked = origin | {"WARC-Refers-To": source["WARC-Record-ID"]} | ({"WARC-Payload-Digest": source["WARC-Payload-Digest"]} if "WARC-Payload-Digest" in source else {})
    envelope = {"Envelope": {"WARC-Header-Metadata": source, "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": http, "Entity-Length": len(payload), "Entity-Digest": digest(payload), "HTML-Metadata": {"Title": _SPACES.sub(" ", html.unescape(title)).strip() if title is not None else None, "Links": links}}}}}
    blocks = (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode()), ("conversion", "text/plain", tidy(text).encode()))
    out = []
    for kind, content_type, body in blocks:
        own = record_id(kind, source["WARC-Record-ID"])
        made = record(kind, {"WARC-Record-ID": own} | linked | {"Content-Type": content_type}, body)
        out.append((kind, own, source["WARC-Record-ID"], source.get("WARC-Target-URI", ""), content_type, digest(body), made))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """One response record per input row: ``id_col`` and ``record``. Null URLs and bodies are empty."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        made = [response("" if i is None else str(i), u or "", (h or "").encode(), date) for i, u, h in rows]
        return {id_col: batch.column(0), "record": pa.array(made, pa.binary())}

    return map_arrow(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), work, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Two rows per response record: ``id_col``, ``warc_type``, ``record_id``, ``refers_to``, ``target_uri``,
    ``content_type``, ``block_digest``, ``record``. Repeated rows give repeated results; null records,
    records of other types and bytes that are no record give none. An empty table gives an empty result."""
    names = ["warc_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "record"]

    def work(batch: pa.RecordBatch) -> dict:
        at, rows = [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            try:
                found = derive(data) if data and parse(data)[0].get("WARC-Type") == "response" else []
            except (ValueError, KeyError):
                found = []
            rows.extend(found)
            at.extend([k] * len(found))
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        kinds = [pa.string()] * 6 + [pa.binary()]
        return {id_col: batch.column(0).take(pa.array(at, pa.int64()))} | {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)}

    schema = f"`{id_col}` {records.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names[:-1]) + ", record binary"
    return map_arrow(records.select(F.col(id_col), F.col(record_col)), work, schema)
