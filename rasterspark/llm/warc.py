"""WARC derivatives: response records into linked metadata and plain-text conversion records.

Records are rows (record_id, warc_type, target_uri, date, headers, block). For each response,
`derive` gives a `metadata` record (application/warc-fields: page title, charset, counts, the
payload's digest) and a `conversion` record (text/plain), both with the response's id in
WARC-Refers-To, its URI and date, its block and payload digests, and all of the source's HTTP headers
in order, repeated ones included. `write` and `parse` are exact inverses for single records of the
WARC/1.1 format, `record_headers` and `record_fields` for what a derivative keeps of its source.

The text is made by one forward scan over the page, linear in its length whatever it holds. Bodies
with chunked transfer or gzip (all members) or deflate content encoding are decoded, whatever they unpack
to; one that can't be is taken as it is. A task holds one body and its text at a time. Lines of a head may
end in LF alone; a response without an empty line after its head is all body. Digests are of the bytes
as archived.

A null block counts as empty; a null URI leaves WARC-Target-URI out. Rows that repeat an id are each
derived and get the same derivative ids; where the id is null, ids come from URI and digest. An
empty table gives an empty one. Other columns are ignored, whatever their names. `parse` raises
ValueError where a file is cut off or no record begins.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: Elements whose content is no text, and those that stand on lines of their own.
_RAW = {"script", "style", "noscript", "template"}
_BLOCK = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article nav header footer pre blockquote title head body".split())
_LOWER = {c: c + 32 for c in range(65, 91)}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_TAG_PART = re.compile(r"[>\"']")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}>"


def scan(page: str) -> tuple[str, str]:
    """(text, title) of an HTML page: scripts, styles and comments dropped, blocks on lines of their own.

    Every find starts where the last one ended, and what was not found once is not looked for again.
    An element or comment that is never closed runs to the end of the page; a "<" that begins no tag is text. A ">"
    inside a quoted attribute value does not end its tag.
    """
    low = page.lower()
    if len(low) != len(page):  # some capitals become two characters
        low = page.translate(_LOWER)
    parts, at, title, begun, none = [], 0, None, None, set()

    def find(what, start):
        if what in none:
            return -1
        found = low.find(what, start)
        if found < 0:
            none.add(what)
        return found

    def tag_end(start):
        """Where the tag that starts there ends; a quote counts after "=", and if it is closed."""
        place = start
        while (part := _TAG_PART.search(low, place)) and part[0] != ">":
            before, place = low[place : part.start()], part.end()
            if before.rstrip()[-1:] == "=" and (close := find(part[0], place)) >= 0:
                place = close + 1
        return part.start() if part else -1

    while True:
        start = find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        parts.append(page[at:start])
        if low.startswith("<!--", start):
            end = find("-->", start + 2)
            at = len(page) if end < 0 else end + 3
        else:
            tag = _NAME.match(low, start)
            end = -1
            if (tag or low.startswith(("<!", "<?"), start)) and find(">", start) >= 0:
                end = tag_end(tag.end()) if tag else find(">", start)
            if end < 0:
                parts.append("<")
                at = start + 1
            else:
                at, name = end + 1, tag and tag[1]
                closing = low.startswith("</", start)
                if name in _BLOCK:
                    parts.append("\n")
                if name == "title" and title is None:
                    if not closing:
                        begun = len(parts) if begun is None else begun
                    elif begun is not None:
                        title = "".join(parts[begun:])
                if name in _RAW and not closing:
                    close = find(f"</{name}", at)
                    end = find(">", close) if close >= 0 else -1
                    at = len(page) if end < 0 else end + 1
        if at >= len(page):
            break
    return _lines("".join(parts), "\n"), _lines(title or "", " ")


def _lines(text: str, between: str) -> str:
    lines = (line.strip() for line in _SPACE.sub(" ", html.unescape(text)).split("\n"))
    return between.join(line for line in lines if line)


def plain_text(page: str) -> str:
    return scan(page)[0]


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if end + 2 + size > len(body):
            raise ValueError("a chunk is cut off")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _unpacked(body: bytes, coding: str) -> bytes:
    gzip = coding in ("gzip", "x-gzip")
    for window in (31,) if gzip else (15, -15):
        try:
            out, left = [], body
            while left:
                made = zlib.decompressobj(window)
                out.append(made.decompress(left))
                if not made.eof:
                    break
                left = made.unused_data
                if not (gzip and left.startswith(b"\x1f\x8b")):  # what follows the last member is padding
                    return b"".join(out)
        except zlib.error:
            pass
    raise ValueError(f"not {coding}, or cut off")


def payload(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers in order (names in lower case) and body of an HTTP response; a block without a status line, or without an
    empty line, is all body.
    """
    end = _HEAD_END.search(block) if block.startswith(b"HTTP/") else None
    if end is None:
        return [], block
    fields = (line.rstrip("\r").partition(":") for line in block[: end.start()].decode("latin-1").split("\n")[1:])
    return [(k.strip().lower(), v.strip()) for k, _, v in fields], block[end.end() :]


def decoded(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without its transfer and content encoding; as it is if that fails."""
    held = dict(fields)
    try:
        if "chunked" in held.get("transfer-encoding", "").lower():
            body = _unchunked(body)
        for coding in reversed([x.strip().lower() for x in held.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip", "deflate"):
                body = _unpacked(body, coding)
    except ValueError:
        pass
    return body


def write(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if k.lower() != "content-length"), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes):
    """(headers, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(at, end)].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = [(k.decode(), v.decode().strip()) for k, _, v in (x.partition(b":") for x in lines[1:])]
        size = int(dict((k.lower(), v) for k, v in headers).get("content-length", "-1"))
        if size < 0 or end + 4 + size + 4 > len(data):
            raise ValueError(f"the record at byte {at} is cut off or has no length")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_FIELD = "struct<name:string,value:string>"
SCHEMA = f"record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, source_headers array<{_FIELD}>, source_digest string, payload_digest string, block_digest string, block binary"


def derive(responses: DataFrame) -> DataFrame:
    """Response rows (record_id, target_uri, date, block) -> two derivative rows each."""

    def one(record_id, uri, date, block):
        fields, archived = payload(block)
        held, body = dict(fields), decoded(fields, archived)
        charset = re.search(r"charset=[\"']?([\w-]+)", held.get("content-type", ""), re.I)
        try:
            page = body.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            page = body.decode("utf-8", "replace")
        text, title = scan(page)
        facts = [
            ("title", title),
            ("charset", charset[1] if charset else "utf-8"),
            ("payload-bytes", len(body)),
            ("text-bytes", len(text.encode("utf-8", "replace"))),
            ("payload-digest", digest(archived)),
            *((f"source-{k}", v) for k, v in fields),
        ]
        about = "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "replace")
        source = record_id if record_id is not None else f"{uri} {digest(block)}"
        for kind, mime, made in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
            pairs = [{"name": k, "value": v} for k, v in fields]
            yield (derived_id(source, kind), kind, record_id, uri, date, mime, pairs, digest(block), digest(archived), digest(made), made)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")]
            out = [row for r, u, d, b in zip(*columns) for row in one(r, u, d, b or b"")]
            kinds = [pa.string()] * 6 + [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))] + [pa.string()] * 3 + [pa.binary()]
            names = "record_id warc_type refers_to target_uri date content_type source_headers source_digest payload_digest block_digest block".split()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=names)

    return responses.select("record_id", "target_uri", "date", "block").mapInArrow(run, SCHEMA)


#: WARC header names of a derivative's columns; the extension fields keep what the standard has no name for.
_HEADERS = [
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
    ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("WARC-Source-Block-Digest", "source_digest"), ("WARC-Source-Payload-Digest", "payload_digest"),
]


def record_headers(row) -> list[tuple[str, str]]:
    """Headers of a derivative row, in the order they are written."""
    pairs = [(name, row[column]) for name, column in _HEADERS if row[column] is not None]
    return pairs + [("WARC-Source-Header", f"{h['name']}: {h['value']}") for h in row["source_headers"] or []]


def record_fields(headers: list[tuple[str, str]]) -> dict:
    """The columns of a derivative row from the headers of its record."""
    held = dict(headers)
    sources = [v.partition(":") for k, v in headers if k == "WARC-Source-Header"]
    return {column: held.get(name) for name, column in _HEADERS} | {"source_headers": [{"name": k, "value": v.strip()} for k, _, v in sources]}


def encode(records: DataFrame) -> DataFrame:
    """Derivative rows -> (record_id, record binary): the records as written to a WARC file."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array([write(record_headers(r), r["block"] or b"") for r in rows], pa.binary())], names=["record_id", "record"])

    return records.mapInArrow(run, "record_id string, record binary")


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Raw pages (page_id, url, html) as response records with an HTTP head."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(head.cast("binary"), body).alias("block"),
    )
