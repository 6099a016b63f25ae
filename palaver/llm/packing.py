"""Packing documents into sequences by best-fit decreasing.

A document's ids (and a closing id) are first cut into full windows; what is left is
placed, longest first, in the open window with the least room that still takes it. The
open windows lie in a segment tree over remaining capacity, so a placement costs
O(log capacity). Pieces are dealt to shards by a hash of document and place, and each
shard is packed on its own: a shard holds a bounded number of pieces, so more rows
mean more shards, not larger ones.

Only (place, length, checksum) of a piece travels; ids are made once, where the text is read.

Defined results: a null or empty text is the closing id alone. Every row is a document,
repeated rows too (their pieces are packed apiece). Null ids and extra columns do no harm.
An empty table gives no piece.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import lean, small_batches

CAPACITY = 2048
CLOSING_ID = 1
#: Rows of input per shard; bounds the pieces that one task packs.
SHARD_ROWS = 4096
#: Distinct chunks whose ids a worker remembers (about 160 bytes each) before it starts anew.
CACHE_CHUNKS = 250_000
#: Bytes of text that are split into chunks at once (a longer text is split whole).
TEXT_AT_ONCE = 1 << 20
TOKENIZER = "byte_bpe_50k"

#: White space of the Unicode White_Space property (fixed values), as the tokenizers' \s has it.
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space next to other white space or at an end of the text.
_IRREGULAR = f"^ | $| [{_WS}]|[{_WS}] "


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to the tokenizers library's.

    The byte-level pre-tokenizer always parts before a space that stands alone between other
    characters, so the chunks between such spaces have their ids on their own. A batch is
    split there, its distinct chunks are looked up, new ones go through byte-pair merging,
    and the ids are gathered by numpy. Texts with other spacing are encoded as a whole;
    those that hold a special token's string go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        import base64

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("palaver", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def slow(self):
        """The tokenizers library's; read only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk with a space before it."""
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        encode = self.fast.encode_ordinary
        out = []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = known[chunk] = array("I", encode(" " + chunk)).tobytes()
            out.append(ids)
        return out

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, some texts at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TEXT_AT_ONCE
        ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return [ids for lo, hi in zip(ends, ends[1:]) for ids in self._encode_some(texts.slice(lo, hi - lo))]

    def _encode_some(self, texts: pa.Array) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = np.full(len(texts), self.fast is None)
        if self.fast is not None:
            whole = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False).copy()
            for s in self.special:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole):
            out[i] = self.encode(texts[int(i)].as_py())
        rest = np.flatnonzero(~whole)
        if not len(rest):
            return out
        lists = pc.split_pattern(texts.take(pa.array(rest)), " ")
        ends = lists.offsets.to_numpy()
        chunks = lists.flatten().dictionary_encode()
        at = chunks.indices.to_numpy().astype(np.int64)
        distinct = chunks.dictionary.to_pylist()
        ids = self._chunk_ids(distinct)
        # the first chunk of a text has no space before it
        firsts = ends[:-1]
        ids += [array("I", self.fast.encode_ordinary(distinct[j])).tobytes() for j in at[firsts]]
        at[firsts] = len(distinct) + np.arange(len(firsts))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), np.dtype("<u4"))
        lengths = size[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        gathered = flat[np.repeat(start[at] - before[:-1], lengths) + np.arange(before[-1])]
        for i, lo, hi in zip(rest, before[ends[:-1]], before[ends[1:]]):
            out[i] = gathered[lo:hi].tobytes()
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_path: str | None = None) -> Encoder:
    """One encoder per worker process; the default is the public byte-level vocabulary."""
    if json_path not in _ENCODERS:
        if json_path is None:
            import public_tokenizers as public

            made = Encoder(public.path(f"{TOKENIZER}.json"), public.path(f"{TOKENIZER}.tiktoken"), public.PATTERN)
        else:
            made = Encoder(json_path)
        _ENCODERS[json_path] = made
    return _ENCODERS[json_path]


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full windows, then the rest."""
    return [(s, min(capacity, total - s)) for s in range(0, total, capacity)]


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open window has."""
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; ``lengths`` must not rise."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, opened = OpenWindows(capacity), 0
    for i, length in enumerate(lengths.tolist()):
        room = open_.tightest(length) if length < capacity else None
        if room is None:
            window, room, opened = opened, capacity, opened + 1
        else:
            window = open_.take(room)
        windows[i], offsets[i] = window, capacity - room
        if room > length:
            open_.put(room - length, window)
    return windows, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, json_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids as little-endian 32-bit bytes.

    ``copy`` is the number of equal pieces before it in its task. Null ids stay null.
    """
    small_batches(docs.sparkSession, 1000)
    id_field = docs.schema["doc_id"]
    schema = f"doc_id {id_field.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, copy long" + ", ids binary" * with_ids

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(json_path).encode_batch, np.array([CLOSING_ID], "<u4").tobytes()
        seen: Counter = Counter()
        for batch in batches:
            doc, start, length, crc, total, copy, ids = [], [], [], [], [], [], []
            names_of = batch.column(0).to_pylist()
            for row, ids_of in enumerate(encode(batch.column(1))):
                raw = ids_of + closing
                n = len(raw) // 4
                for s, m in cut(n, capacity):
                    part = raw[4 * s : 4 * (s + m)]
                    doc.append(row)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    same = names_of[row], s, crc[-1]
                    copy.append(seen[same])
                    seen[same] += 1
                    if with_ids:
                        ids.append(part)
            long = [batch.column(0).take(pa.array(doc, pa.int64()))]
            long += [pa.array(x, pa.int64()) for x in (start, length, crc, total, copy)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
            if with_ids:
                yield pa.RecordBatch.from_arrays([*long, pa.array(ids, pa.binary())], names=[*names, "ids"])
            else:
                yield pa.RecordBatch.from_arrays(long, names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(tokenised), schema)


def pack(
    docs: DataFrame, *, capacity: int = CAPACITY, json_path: str | None = None, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """doc_id (of the type it has), start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    Pieces are dealt to shards by a hash; the k-th of equal pieces in a task goes k shards on,
    so that equal rows do not meet in one. That depends on which rows a task has, not on
    their order, so a task that runs again deals alike.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    cut_up = pieces(docs, capacity=capacity, json_path=json_path)
    place = F.xxhash64("doc_id", "start", "ids_crc32") + F.col("copy")
    dealt = cut_up.withColumn("shard", F.pmod(place, F.lit(shards)))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        window, frame["offset"] = best_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = frame["shard"].to_numpy(np.int64) * (1 << 32) + window
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("shard").applyInPandas(packed, PIECES.replace("doc_id long", f"doc_id {id_type}"))
