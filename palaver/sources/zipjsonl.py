"""A data source for JSON lines and large JSON objects inside zip archives.

``spark.read.format("zipjsonl").option("path", ...)`` gives (archive, ingest_seq, id, value): a
row per non-blank line of the member ``utterances.jsonl`` (option ``member``), wherever it lies
in the archive. ``ingest_seq`` rises in the order of reading: the line's first byte within the
member. With option ``member`` = ``conversations.json`` the one big object gives a row per
entry: value is the entry's JSON, id its key, ingest_seq its number.

``path`` is a file, a folder or a pattern in the last part of the path, local or with a scheme
that ``pyarrow.fs`` opens (file, hdfs, s3, gs, abfs); option ``filesystem`` names another one, as
``module:function`` that returns a ``pyarrow.fs.FileSystem``, importable by the executors. Archives
are opened there by driver and tasks alike; no path is taken for local.

Partitions are planned from the archives' central directories. Stored members are split
at lines every ``splitBytes`` (64 MB); compressed ones are read as a stream by one task, for they
can't be entered in the middle; small ones share a task up to ``packBytes`` (16 MB). Wanted ids can be pushed
down (``id IN`` or ``id =``); an object is read no further than its last wanted entry, and
entries that are not wanted are not decoded.
"""

from __future__ import annotations

import fnmatch
import importlib
import io
import json
import os
import posixpath
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "archive string, ingest_seq bigint, id string, value string"
_ARROW = pa.schema([("archive", pa.string()), ("ingest_seq", pa.int64()), ("id", pa.string()), ("value", pa.string())])
#: Bytes read at once.
_CHUNK = 1 << 20
#: Bytes of values in an Arrow batch, and its rows.
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 10_000


@dataclass(frozen=True)
class Piece:
    """A member of an archive; bytes begin to end of it where it is stored, else the whole."""

    path: str
    member: str
    offset: int | None = None
    begin: int = 0
    end: int = 0


class Share(InputPartition):
    """What one task reads."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)
        self.pieces = pieces


def filesystem(path: str, factory: str | None = None) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if factory:
        module, _, name = factory.partition(":")
        return getattr(importlib.import_module(module), name)(), path
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def archives(path: str, factory: str | None = None) -> list[str]:
    """Archive files of a path, a folder or a pattern, by name; none is an error."""
    head, name = posixpath.split(path)
    if not any(c in name for c in "*?["):
        system, inside = filesystem(path, factory)
        info = system.get_file_info(inside)
        if info.type == pafs.FileType.File:
            return [path]
        head, name = path, "*.zip"
        found = system.get_file_info(pafs.FileSelector(inside)) if info.type == pafs.FileType.Directory else []
    else:
        system, inside = filesystem(head or ".", factory)
        found = system.get_file_info(pafs.FileSelector(inside, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, name))
    if not names:
        raise FileNotFoundError(f"no archive at {path}")
    return [posixpath.join(head, n) for n in names]


class _Raw(io.RawIOBase):
    """A random-access file of ``pyarrow`` for ``io.BufferedReader``."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str, factory: str | None = None) -> io.BufferedReader:
    system, inside = filesystem(path, factory)
    return io.BufferedReader(_Raw(system.open_input_file(inside)), _CHUNK)


def member_of(names: list[str], wanted: str) -> str:
    for name in names:
        if name == wanted or name.endswith("/" + wanted):
            return name
    raise FileNotFoundError(f"no {wanted} in the archive")


def planned(path: str, member: str, factory: str | None = None, split: int = 64 << 20, pack: int = 16 << 20) -> list[Share]:
    """Shares of all archives, from their central directories."""

    def sized(archive: str) -> list[tuple[int, Piece]]:
        with opened(archive, factory) as file, zipfile.ZipFile(file) as z:
            info = z.getinfo(member_of(z.namelist(), member))
            if info.compress_type != zipfile.ZIP_STORED or not member.endswith(".jsonl") or info.file_size <= split:
                return [(info.compress_size, Piece(archive, info.filename))]
            file.seek(info.header_offset + 26)
            lengths = file.read(4)  # of the name and the extra field, in the local header
            data = info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
            cuts = [*range(0, info.file_size, split), info.file_size]
            return [(e - b, Piece(archive, info.filename, data, b, e)) for b, e in zip(cuts, cuts[1:])]

    with ThreadPoolExecutor(16) as pool:
        every = [x for found in pool.map(sized, archives(path, factory)) for x in found]
    shares, size = [[]], 0
    for n, piece in every:
        if shares[-1] and size + n > pack:
            shares.append([])
            size = 0
        shares[-1].append(piece)
        size += n
    return [Share(s) for s in shares]


def stored_lines(file: io.BufferedReader, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place in the member, line) of the lines that begin in the piece."""
    at = piece.begin
    file.seek(piece.offset + max(0, at - 1))
    if at:  # a line that begins before belongs to the piece before
        at = at - 1 + len(file.readline())
    with zipfile.ZipFile(file) as z:
        size = z.getinfo(piece.member).file_size
    file.seek(piece.offset + at)
    while at < piece.end:
        line = file.readline()[: size - at]
        if not line:
            return
        yield at, line
        at += len(line)


class ObjectScanner:
    """Splits one JSON object that comes in chunks into (key, value), as bytes, each byte looked at once.

    What carries over a chunk's end: whether a string is open, whether the next byte is
    escaped, the depth, and the parts of the key or value that has begun.
    """

    def __init__(self):
        self.string = self.escaped = self.started = self.ended = False
        self.depth, self.parts, self.key = 0, [], None

    def feed(self, chunk: bytes) -> Iterator[tuple[bytes, bytes]]:
        if self.ended:
            return
        b = np.frombuffer(chunk, np.uint8)
        quote = b == 34
        slash = np.flatnonzero(b == 92)
        if self.escaped or len(slash):
            quote[self._escaped(slash, len(b))] = False
        inside = (np.cumsum(quote) + self.string) % 2 == 1  # a closing quote counts as outside
        plain = ~inside
        rise = ((b == 123) | (b == 91)) & plain
        fall = ((b == 125) | (b == 93)) & plain
        depth = self.depth + np.cumsum(rise.astype(np.int64) - fall)
        top = plain & (((b == 44) | (b == 58)) & (depth == 1) | fall & (depth == 0) | rise & (depth == 1))
        begin = 0
        for i in np.flatnonzero(top).tolist():
            mark = chunk[i : i + 1]
            if not self.started:
                if mark != b"{" or chunk[begin:i].strip() or b"".join(self.parts).strip():
                    raise ValueError("the member is not an object")
                self.started, self.parts, begin = True, [], i + 1
                continue
            if mark in b"{[":
                raise ValueError("the object is broken")
            text = b"".join([*self.parts, chunk[begin:i]])
            self.parts, begin = [], i + 1
            if mark == b":":
                if self.key is not None:
                    raise ValueError("the object is broken")
                self.key = text
                continue
            if self.key is not None:
                yield self.key, text
            elif text.strip():
                raise ValueError("the object is broken")
            self.key = None
            if mark in b"}]":
                self.ended = True
                return
        self.parts.append(chunk[begin:])
        self.string = bool(inside[-1]) if len(b) else self.string
        self.depth = int(depth[-1]) if len(b) else self.depth

    def _escaped(self, slash: np.ndarray, n: int) -> np.ndarray:
        """Positions of escaped bytes: those after an odd number of backslashes."""
        carried = self.escaped
        if not len(slash):
            self.escaped = False if n else carried
            return np.zeros(1 if n else 0, np.int64)
        first = np.flatnonzero(np.append(True, np.diff(slash) != 1))
        begin, length = slash[first], np.diff(np.append(first, len(slash)))
        if carried and begin[0] == 0:  # the chunk's first backslash is itself escaped
            length[0] -= 1
        after = (slash[first] + np.diff(np.append(first, len(slash))))[length % 2 == 1]
        self.escaped = bool(len(after) and after[-1] == n)
        out = after[after < n]
        return np.append(out, 0) if carried and begin[0] != 0 else out

    def close(self) -> None:
        if not self.started and b"".join(self.parts).strip():
            raise ValueError("the member is not an object")
        if not self.ended:
            raise ValueError("the object is cut short")


def object_entries(stream: io.BufferedIOBase, chunk: int | None = None) -> Iterator[tuple[str, bytes]]:
    """(key, JSON of the value) of one JSON object, read by chunks."""
    scan = ObjectScanner()
    while data := stream.read(chunk or _CHUNK):
        for key, value in scan.feed(data):
            yield str(json.loads(key)), value.strip()
        if scan.ended:
            return
    scan.close()


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.path, self.member, self.factory = get("path", ""), get("member", "utterances.jsonl"), get("filesystem")
        self.sizes = int(get("splitbytes", 64 << 20)), int(get("packbytes", 16 << 20))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                self.wanted = {f.value} & self.wanted if self.wanted is not None else {f.value}
            elif isinstance(f, In) and f.attribute == ("id",):
                self.wanted = set(f.value) & self.wanted if self.wanted is not None else set(f.value)
            yield f  # Spark still checks each row

    def partitions(self) -> list[Share]:
        return planned(self.path, self.member, self.factory, *self.sizes)

    def _lines(self, lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, str | None, str]]:
        for at, line in lines:
            line = line.strip()
            if not line:
                continue
            text = line.decode("utf-8")
            entry = json.loads(text)  # a malformed line is an error
            key = (entry.get("id") or entry.get("utterance_id")) if isinstance(entry, dict) else None
            key = None if key is None else str(key)
            if self.wanted is None or key in self.wanted:
                yield at, key, text

    def _entries(self, stream: io.BufferedIOBase) -> Iterator[tuple[int, str, str]]:
        left = None if self.wanted is None else set(self.wanted)
        if left is not None and not left:
            return
        for i, (key, value) in enumerate(object_entries(stream)):
            if left is None or key in left:
                text = value.decode("utf-8")
                json.loads(text)  # a malformed value is an error
                yield i, key, text
                if left is not None:
                    left.discard(key)
                    if not left:
                        return

    def _rows(self, piece: Piece) -> Iterator[tuple[int, str | None, str]]:
        with opened(piece.path, self.factory) as file:
            if piece.offset is not None:
                yield from self._lines(stored_lines(file, piece))
                return
            with zipfile.ZipFile(file) as z, z.open(piece.member) as raw:
                if not self.member.endswith(".jsonl"):
                    yield from self._entries(raw)
                    return

                def lines():
                    at = 0
                    for line in io.BufferedReader(raw, _CHUNK):
                        yield at, line
                        at += len(line)

                yield from self._lines(lines())

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            name, rows, size = posixpath.basename(piece.path), [], 0
            for row in self._rows(piece):
                rows.append((name, *row))
                size += len(row[2])
                if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ZipJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipjsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipJsonl)
