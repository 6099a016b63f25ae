"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record becomes two records that refer to it: ``metadata`` (warc-fields with the
title, links and facts of the page) and ``conversion`` (its text). Each derivative keeps the
source's target URI, date and record id (WARC-Refers-To, -Target-URI, -Date), the metadata
record also the source's digests and HTTP headers. Record ids are derived from the
source's id and the derivative's digest, so a task that runs again writes equal records.

``respond`` makes response records of pages, ``record_bytes`` and ``parse_records`` write and
read the format, and ``derive`` maps batches of responses; nothing is shuffled.

Defined results: a null or empty body gives an empty text and no links; a null URL is an empty
target; a response without a record id still gets derivatives, with a refers-to made of its
URL and body digest. A broken record gives one error row and harms no other. Repeated rows
give repeated (equal) records. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import small_batches

VERSION = "WARC/1.1"
#: Date of records made from pages, which have none.
PAGE_DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

#: Elements whose content is not text, and those that end a line (fixed values).
SKIPPED = "script style noscript template svg head iframe"
BLOCKS = "address article aside blockquote br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul"

# No pattern can run over the "<" of another tag, so that scanning takes time in proportion.
_SKIP = re.compile(r"<(%s)\b[^<>]*>.*?(?:</\1\s*>|\Z)" % "|".join(SKIPPED.split()), re.S | re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>", re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9_]*)[^<>]*>")
_BLOCK_NAMES = frozenset(BLOCKS.split())
_TITLE = re.compile(r"<title\b[^<>]*>", re.I)
_TITLE_END = re.compile(r"</title\s*>", re.I)
_ANCHOR = re.compile(r"<a\b([^<>]*)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HTML = re.compile(r"<html\b([^<>]*)", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _shown(page: str) -> tuple[str, str]:
    """The page without comments, and without skipped elements too."""
    page = _COMMENT.sub(" ", page)
    return page, _SKIP.sub(" ", page)


def page_text(body: str) -> str:
    """The text of what is shown: a line per block element, white space collapsed, blank lines left out."""
    parts = _TAG.split(body)  # texts and tag names in turn
    parts[1::2] = ["\n" if name.lower() in _BLOCK_NAMES else "" for name in parts[1::2]]
    lines = (" ".join(line.split()) for line in entities.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line)


def page_facts(page: str, body: str) -> tuple[str, str, list[str]]:
    """Title, language and link targets (in order, with repeats)."""
    title = lang = ""
    if start := _TITLE.search(page):
        if end := _TITLE_END.search(page, start.end()):
            title = _one_line(page[start.end() : end.start()])
    for tag in _HTML.finditer(page):
        if found := _LANG.search(tag[1]):
            lang = found[1].lower()
            break
    links = [_one_line(m[1] or m[2] or m[3] or "") for tag in _ANCHOR.finditer(body) if (m := _HREF.search(tag[1]))]
    return title, lang, links


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(parts))}>"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Broken(ValueError):
    """A record that does not keep to the format."""


_VERSION = re.compile(rb"WARC/\d[^\r\n]*\r?\n")
_NEXT = re.compile(rb"\nWARC/\d")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields: ``name:value``, spaces around the value left out, folded lines joined."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise Broken(f"no field: {line[:60]!r}")
            out.append((name.strip(), value.strip()))
    return out


def scan_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes] | Broken]:
    """(headers without Content-Length, block) of each record, or what is wrong with it.

    After a broken record the scan goes on at the next line that starts one.
    """
    at = 0
    while at < len(data):
        try:
            version = _VERSION.match(data, at)
            if not version:
                raise Broken(f"no record at byte {at}")
            end = _HEAD_END.search(data, version.end() - 1)
            if not end:
                raise Broken(f"no end of the header at byte {at}")
            headers = _fields(data[version.end() : end.start()])
            sizes = {v for k, v in headers if k.lower() == "content-length"}
            if len(sizes) != 1 or not (size := sizes.pop()).isascii() or not size.isdigit():
                raise Broken(f"no single Content-Length at byte {at}")
            stop = end.end() + int(size)
            tail = data[stop : stop + 4]
            if stop > len(data) or not (tail.startswith((b"\r\n\r\n", b"\n\n")) or not tail.strip(b"\r\n")):
                raise Broken(f"the block of the record at byte {at} is not {size} bytes")
            yield [h for h in headers if h[0].lower() != "content-length"], data[end.end() : stop]
            at = stop
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
        except Broken as error:
            yield error
            following = _NEXT.search(data, at + 1)
            at = following.start() + 1 if following else len(data)


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """``scan_records``; raises on a broken record."""
    for record in scan_records(data):
        if isinstance(record, Broken):
            raise record
        yield record


def response(url: str, page: str, page_id: int | None, date: str = PAGE_DATE) -> bytes:
    """A response record with an HTTP block around the page."""
    body = page.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", url, str(page_id), digest(body))),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(http)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record_bytes(headers, http)


def split_http(block: bytes) -> tuple[str, list[str], bytes]:
    """Status line, header lines and body of an HTTP message."""
    end = _HEAD_END.search(block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    status, *lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    return status, lines, body


def _unchunked(body: bytes) -> bytes:
    """The data of chunks; where a chunk is malformed, the rest as it is."""
    out, at = [], 0
    while at < len(body):
        line = body.find(b"\n", at)
        try:
            size = int(body[at : line if line >= 0 else at].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) + body[at:]
        if not size:
            break
        out.append(body[line + 1 : line + 1 + size])
        at = line + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out)


def page_of(http: list[str], body: bytes) -> str:
    """The page in a body, by its transfer and content encodings and its charset (UTF-8 where
    none is known); what cannot be undone is taken as it is."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http)}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
        wbits = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding.strip(), ())
        for bits in wbits:
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def derivatives(source: bytes) -> list[tuple[str, list[tuple[str, str]], bytes] | Broken]:
    """(type, headers, block) of the metadata and the conversion record of each response record;
    what is wrong with a broken record stands in its place."""
    out = []
    for record in scan_records(source):
        if isinstance(record, Broken):
            out.append(record)
            continue
        headers, block = record
        of = {k.lower(): v for k, v in headers}
        if of.get("warc-type") != "response":
            continue
        status, http, body = split_http(block)
        page = page_of(http, body)
        uri, date = of.get("warc-target-uri", ""), of.get("warc-date", PAGE_DATE)
        payload = of.get("warc-payload-digest") or digest(body)
        refers = of.get("warc-record-id") or record_id("response", uri, payload)
        page, shown = _shown(page)
        title, lang, links = page_facts(page, shown)
        text = page_text(shown).encode("utf-8", "surrogatepass")
        fields = [("source-status", status)]
        fields += [("source-header", line) for line in http]
        fields += [("source-payload-digest", payload), ("source-block-digest", of.get("warc-block-digest") or digest(block))]
        fields += [("title", title), ("language", lang), ("links", str(len(links)))]
        fields += [("outlink", link) for link in links]
        facts = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
        for kind, content, data in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain; charset=utf-8", text)):
            out.append(
                (
                    kind,
                    [
                        ("WARC-Type", kind),
                        ("WARC-Record-ID", record_id(kind, refers, digest(data))),
                        ("WARC-Refers-To", refers),
                        ("WARC-Refers-To-Target-URI", uri),
                        ("WARC-Refers-To-Date", date),
                        ("WARC-Date", date),
                        ("WARC-Target-URI", uri),
                        ("WARC-Block-Digest", digest(data)),
                        ("Content-Type", content),
                    ],
                    data,
                )
            )
    return out


def respond(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id and ``record``, the bytes of a response record."""
    small_batches(pages.sparkSession, 1000)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = (batch.column(i).to_pylist() for i in range(3))
            records = [response(" ".join((u or "").split()), t or "", i) for i, u, t in zip(ids, urls, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary())], names=["page_id", "record"])

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(made, "page_id long, record binary")


DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, content_length long, record binary, error string"


def derive(responses: DataFrame) -> DataFrame:
    """responses (page_id, record): one row per derivative, with the record's bytes; a broken
    record gives one row of type ``error`` that says what is wrong, its other columns null."""
    small_batches(responses.sparkSession, 1000)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in DERIVED.split(", ")]
        for batch in batches:
            rows = []
            for page_id, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in derivatives(source.as_py() or b""):
                    if isinstance(found, Broken):
                        rows.append((page_id, "error", *[None] * 6, str(found)))
                        continue
                    kind, headers, block = found
                    of = dict(headers)
                    rows.append(
                        (page_id, kind, of["WARC-Record-ID"], of["WARC-Refers-To"], of["WARC-Target-URI"])
                        + (of["WARC-Block-Digest"], len(block), record_bytes(headers, block), None)
                    )
            types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return responses.select("page_id", "record").mapInArrow(made, DERIVED)


def _members(data: bytes) -> Iterator[bytes]:
    """Unpacked members of a gzip file, one at a time; a file that is not gzip is one member."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        unpack, parts = zlib.decompressobj(31), []
        try:
            while not unpack.eof and at < len(data):
                window = view[at : at + _WINDOW]
                parts.append(unpack.decompress(window))
                # what lies behind the member's end is looked at again, one window at most
                at += len(window) - len(unpack.unused_data)
        except zlib.error as error:
            yield f"gzip: {error}".encode()  # scanned as a broken record
            return
        yield b"".join(parts)


#: Packed bytes that are unpacked at once, and record bytes of an Arrow batch.
_WINDOW, _BATCH_BYTES = 64 << 10, 4 << 20


def _records(numbers: list[int], records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(records, pa.binary())], names=["page_id", "record"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files below ``path``, plain or of gzip members, as (page_id, record):
    page_id counts the records of a file. Read by Spark, so any file system will do; a file
    is held by one task, and Spark reads files up to 2 GB so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                numbers, records, size, number = [], [], 0, 0
                for member in _members(content.as_py()):
                    for record in scan_records(member):
                        whole = str(record).encode() if isinstance(record, Broken) else record_bytes(*record)
                        numbers.append(number)
                        records.append(whole)
                        size, number = size + len(whole), number + 1
                        if size >= _BATCH_BYTES:
                            yield _records(numbers, records)
                            numbers, records, size = [], [], 0
                if records:
                    yield _records(numbers, records)

    return files.mapInArrow(cut_up, "page_id long, record binary")
