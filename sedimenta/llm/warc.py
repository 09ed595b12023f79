"""WARC derivatives: each response record gives a metadata and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, in_slices, quoted

DATE = "2024-01-01T00:00:00Z"
# Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe")
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
LINKED = ("a", "link", "img", "meta")
# a tag's end is no > within a quoted value; a quote that no other closes within 64 K characters is a character
_tag = re.compile(r"""<(?:(!--)|[!?][^>]*>?|(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>=]|=\s*"[^"]{0,65535}"|=\s*'[^']{0,65535}'|=)*)>?)""")
_closers = {"!--": re.compile("-->")} | {name: re.compile(rf"</{name}[^>]*>", re.I) for name in SILENT}
_attribute = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_blank = re.compile(r"[ \t\r\f\v\xa0]+")
_charset = re.compile(rb"""<meta[^>]{0,512}charset\s*=\s*["']?\s*([a-zA-Z0-9_.:-]+)""", re.I)
HTML_TYPES = ("text/html", "application/xhtml+xml", "")
Headers = list[tuple[str, str]]


PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
PAIRS_SPEC = "array<struct<name: string, value: string>>"


def _structs(headers: Headers) -> list[dict]:
    return [{"name": k, "value": v} for k, v in headers]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def scan_html(page: str) -> tuple[str, dict]:
    """The visible text, a line for each block, and title, metas and links. One pass; unclosed parts end with the page."""
    text, at, n = [], 0, len(page)
    title, metas, links, into = [], [], [], text
    absent: set[str] = set()

    def after(what: str, start: int) -> int:
        """Where the text goes on behind the next `what`; what was searched in vain is not searched again."""
        found = None if what in absent else _closers[what].search(page, start)
        if found is None:
            absent.add(what)
            return n
        return found.end()

    while m := _tag.search(page, at):
        if m.start() > at:
            into.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                at = after("!--", at)
            continue
        name, closing, rest = name.lower(), m[2], m[4]
        if name == "title":
            into = text if closing else title
        if not closing:
            if name in SILENT:
                if not rest.endswith("/"):
                    at = after(name, at)
                continue
            if name in LINKED:
                found = {x[0].lower(): html.unescape(x[1] or x[2] or x[3]) for x in _attribute.findall(rest)}
                if name == "meta":
                    metas.append(found)
                elif link := found.get("src" if name == "img" else "href"):
                    links.append({"path": f"{name.upper()}@/{'src' if name == 'img' else 'href'}", "url": link})
        if name in BREAKS:
            text.append("\n")
    into.append(page[at:])
    body = html.unescape("".join(text))
    lines = [_blank.sub(" ", s).strip() for s in body.split("\n")]
    return "\n".join(s for s in lines if s), {"Title": _blank.sub(" ", html.unescape("".join(title))).strip(), "Metas": metas, "Links": links}


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def header_pairs(lines: list[str]) -> Headers:
    """(name, value) of each header line, in order and with repeats; an indented line goes on with the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def header(headers: Headers, name: str, default: str | None = None) -> str | None:
    """The first value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


class _Inflated(io.RawIOBase):
    """Gzip members one after another, inflated as they are read; ends where the data end or are no gzip."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left, self.member, self.out = data, 0, b"", None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out and (self.left or self.at < len(self.data)):
            if not self.left:
                self.left, self.at = self.data[self.at : self.at + (1 << 18)], self.at + (1 << 18)
            self.member = self.member or zlib.decompressobj(31)
            try:
                self.out = self.member.decompress(self.left, 1 << 20)
            except zlib.error:
                self.left, self.at = b"", len(self.data)
                break
            self.left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Records of a WARC file, plain or compressed record by record, one after another: only one is inflated at a time.
    A truncated last record is left out, and so is what follows a record whose length is no number."""
    stream = io.BufferedReader(_Inflated(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        headers = header_pairs(lines)
        size = header(headers, "Content-Length", "0")
        if not size.isdigit() or len(block := stream.read(int(size))) < int(size):
            return
        yield headers, block


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def content_of(http: Headers, body: bytes) -> bytes:
    """The body without transfer and content encodings; what can't be undone stays as it is."""
    if "chunked" in (header(http, "Transfer-Encoding") or "").lower():
        body = _dechunked(body)
    for coding in reversed([c.strip().lower() for c in (header(http, "Content-Encoding") or "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif coding == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
        except zlib.error:
            break
    return body


def text_of(http: Headers, body: bytes) -> str:
    """The body decoded by the charset of its header, else of its meta element, else UTF-8; bad bytes are replaced."""
    named = re.search(r"charset\s*=\s*\"?([a-zA-Z0-9_.:-]+)", header(http, "Content-Type") or "", re.I)
    found = named[1] if named else next((m[1].decode() for m in [_charset.search(body[:4096])] if m), "utf-8")
    try:
        return body.decode(found, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def _record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def _response(page_id, url: str | None, page: str | None, date: str = DATE) -> tuple[Headers, bytes]:
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    payload = digest(body)
    headers = {"WARC-Type": "response", "WARC-Record-ID": _record_id("response", str(page_id), url or "", payload), "WARC-Date": date}
    headers |= {"WARC-Target-URI": url} if url is not None else {}
    headers |= {"WARC-Payload-Digest": payload, "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return list(headers.items()), block


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of crawled pages: source_id, WARC headers as (name, value) in order, and the block (HTTP head and body).

    A null url has no target header, a null page an empty body. Rows repeated in id, url and page get the same record."""
    schema = pa.schema([("source_id", pa.int64()), ("headers", PAIRS), ("block", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in in_slices(batch):
                out = []
                for page_id, url, page in zip(*(c.to_pylist() for c in part.columns)):
                    headers, block = _response(page_id, url, page, date)
                    out.append((page_id, _structs(headers), block))
                if out:
                    yield batch_of(schema, [list(c) for c in zip(*out)])

    return pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(html_col)).alias("html")).mapInArrow(run, f"source_id bigint, headers {PAIRS_SPEC}, block binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: source_id null, headers, block. A file is one task's work and memory, as crawls cut them."""
    schema = pa.schema([("source_id", pa.int64()), ("headers", PAIRS), ("block", pa.binary())])

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for headers, block in parse(data):
                    yield batch_of(schema, [[None], [_structs(headers)], [block]])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"source_id bigint, headers {PAIRS_SPEC}, block binary")


def _derive(headers: Headers, block: bytes) -> list[tuple[str, Headers, bytes]]:
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = header_pairs(lines)
    kind = (header(http, "Content-Type") or "").split(";")[0].strip().lower()
    content = content_of(http, body)
    payload = {"Response-Line": status, "Headers": http, "Entity-Digest": digest(body), "Entity-Length": len(body)}
    text = None
    if kind in HTML_TYPES:
        text, payload["HTML-Metadata"] = scan_html(text_of(http, content))
    elif kind.startswith("text/"):
        text = text_of(http, content)
    source = header(headers, "WARC-Record-ID", "")
    envelope = {"Envelope": {"WARC-Header-Metadata": headers, "Payload-Metadata": {"HTTP-Response-Metadata": payload}}}
    made = []
    for kind, content_type, data in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), *([("conversion", "text/plain", text.encode("utf-8", "replace"))] if text is not None else [])):
        own = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(kind, source or digest(block))), ("WARC-Refers-To", source), ("WARC-Date", header(headers, "WARC-Date", DATE))]
        own += [(k, v) for k in ("WARC-Target-URI", "WARC-IP-Address") if (v := header(headers, k)) is not None]
        own += [("WARC-Source-Payload-Digest", header(headers, "WARC-Payload-Digest") or digest(body)), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        made.append((kind, own, data))
    return made


def derivatives(records: DataFrame) -> DataFrame:
    """Rows for each response of records(source_id, headers, block): record_type metadata, and conversion where the
    response is HTML (or names no type) or other text; their headers (refers-to, target, date and payload digest as in
    the source), block and the serialised record. The metadata block holds all headers of the source, in order.

    Bodies are read by their transfer and content encoding and charset; digests are of the body as it was sent.
    Records of other types give nothing; null headers or blocks count as empty; repeated responses give repeated rows."""
    schema, spec = _schema([("headers", PAIRS, PAIRS_SPEC), ("block", pa.binary(), "binary"), ("record", pa.binary(), "binary")])
    given = lambda _, headers, block: ([(h["name"], h["value"]) for h in headers or ()], block or b"")
    made = lambda own, data: (_structs(own), data, serialise(own, data))
    return records.select("source_id", "headers", "block").mapInArrow(lambda batches: _rows(batches, schema, given, made), spec)


def _rows(batches, schema: pa.Schema, response, row):
    """What `row` makes of the derivatives of each record that `response` makes of a row."""
    for batch in batches:
        for part in in_slices(batch, 4 << 20):
            out = []
            for source_id, *given in zip(*(c.to_pylist() for c in part.columns)):
                headers, block = response(source_id, *given)
                if header(headers, "WARC-Type", "response").lower() == "response":
                    out += [(source_id, kind, *row(own, data)) for kind, own, data in _derive(headers, block)]
            if out:
                yield batch_of(schema, [list(c) for c in zip(*out)])


def _schema(columns) -> tuple[pa.Schema, str]:
    schema = pa.schema([("source_id", pa.int64()), ("record_type", pa.string()), *((n, t) for n, t, _ in columns)])
    return schema, "source_id bigint, record_type string, " + ", ".join(f"{n} {t}" for n, _, t in columns)


# Columns of the report and the headers that they show.
SHOWN = {"record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "source_payload_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}


def report(pages: DataFrame) -> DataFrame:
    """Derivative records of pages: identifiers, source digests, and digests of the new records. Responses are made and
    converted in one pass, as responses() and derivatives() do one after the other."""

    def row(own, data):
        headers = dict(own)
        return (*(headers.get(h) for h in SHOWN.values()), len(data), hashlib.sha256(serialise(own, data)).hexdigest())

    columns = [*((n, pa.string(), "string") for n in SHOWN), ("content_length", pa.int64(), "bigint"), ("record_sha256", pa.string(), "string")]
    schema, spec = _schema(columns)
    made = pages.select("page_id", "url", "html").mapInArrow(lambda batches: _rows(batches, schema, _response, row), spec)
    return made.withColumnRenamed("source_id", "page_id")
