"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, sorted-array intersection.

A document is the set of its distinct word shingles; equal sets are one node, named by a
128-bit digest, and one of their documents stands for them.

1. Tiles. Sizes are cut into bands so wide that linked sets lie in one band or in two
   neighbouring ones. Linked sets of a band (and the band below it) differ in at most D
   shingles. The range of the hashes is cut into more than D parts, so two linked sets have a
   part in common: (band, part, digest of the part's hashes) is the tile in which they meet.
   A part holds about ten shingles, so a passage that many documents share makes no tile
   of its own. Equal empty parts say nothing; where so many parts of a set are empty that they
   alone could be the common ones, they make tiles too. No linked pair is lost.
2. Members of a tile are compared with its hub, the node that meets the most others, first by
   bitmaps of hashed shingles: each bit that differs is a shingle that differs, so the overlap is
   at most (|x| + |y| - differing bits) / 2. What can reach ``STAR`` percent is then
   intersected exactly, as sorted arrays.
3. Components of the links. Only members outside their hub's component are compared further,
   with members of other components: by prefix filters over their exact differences from the hub (see
   ``neardup``), or, where the bitmaps left the difference open, in blocks of ``BLOCK`` by
   ``BLOCK`` bitmaps of a size band. What the bounds leave is intersected exactly.

A group of near copies costs one comparison for each member and hub, not one for each pair.

Defined results: A-Z are lower-cased, words are runs of other characters than ASCII white
space. A text with fewer words than a shingle is one shingle; null and empty texts, and
texts without words, are empty sets and linked with nothing. Repeated rows give equal rows. A null
doc_id comes after all others of a component. Other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import forget, materialise, row_hash
from palaver.llm.components import components
from palaver.llm.neardup import BROADCAST_ROWS, Shingler, _by_difference, _linked, _mix, _sets, _verified, label

#: Links need 100 * overlap >= PERCENT * union; a shingle has so many words.
PERCENT, SHINGLE = 90, 3
#: Hubs are intersected exactly with members whose bitmaps allow so many percent.
STAR = 70
#: Members of a block of bitmaps.
BLOCK = 512
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@functools.cache
def _lows(percent: int, reach: int) -> np.ndarray:
    """Least sizes of the bands, up to one beyond ``reach``."""
    lows = [1]
    while lows[-1] <= reach:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows)


def band(n: int, percent: int) -> int:
    """Band of a set of n shingles; linked sets lie in one band or in neighbouring ones."""
    return int(np.searchsorted(_lows(percent, 1 << n.bit_length()), n, "right")) - 1


@functools.cache
def tile_parts(number: int, percent: int) -> tuple[int, np.ndarray]:
    """Of a band: D, the most shingles in which linked sets of it and the band below differ, and where its parts begin."""
    low = 1
    for _ in range(number):
        low = low * 100 // percent + 1
    top = low * 100 // percent
    differ = 2 * top * (100 - percent) // (100 + percent)
    parts = differ + 1 + differ // 32
    return differ, np.arange(parts, dtype=np.uint64) * np.uint64((1 << 64) // parts if parts > 1 else 0)


def tiles(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Tiles of a set (sorted hashes), in its own band and as a smaller set in the next one."""
    own = band(len(hashes), percent)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(_mix(hashes * _B + _A), out=sums[1:])
    out = []
    for number in (own, own + 1):
        differ, begin = tile_parts(number, percent)
        if not differ:
            continue  # only equal sets can be linked
        at = np.append(np.searchsorted(hashes, begin), len(hashes))
        part = np.arange(1, len(at), dtype=np.uint64)
        salt = np.uint64(number * int(_A) % (1 << 64))
        key = _mix((sums[at[1:]] - sums[at[:-1]]) * _A + _mix(part * _B + salt))
        full = at[1:] > at[:-1]
        out.append(key if len(full) - full.sum() >= len(full) - differ else key[full])
    return np.concatenate(out) if out else hashes[:0]


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash modulo the size, a power of two that is at least twice the set."""
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(_mix(hashes * _A) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits that differ, the larger bitmap folded to the size of the smaller."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) != len(q):
        p, q = (p, q) if len(p) < len(q) else (q, p)
        q = np.bitwise_or.reduce(q.reshape(-1, len(p)), axis=0)
    return int(np.bitwise_count(p ^ q).sum())


def can_link(n_x: np.ndarray, n_y: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of (n_x + n_y - bits) / 2, and of the smaller set, would be enough."""
    most = np.minimum(n_x + n_y - bits, 2 * np.minimum(n_x, n_y))
    return (100 + percent) * most >= 2 * percent * (n_x + n_y)


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """items (doc_id, th, text): doc_id, th, n, node, tiles and bits; empty sets have null node and no tile."""
    schema = "n long, node binary, tiles array<long>, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t.as_py()) for t in batch.column("text")]
                got = [tiles(h, percent) if len(h) else h for h in sets]
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).view(np.int64)))
                node = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
                bits = [bitmap(h) if len(h) else None for h in sets]
                cols = [batch.column("doc_id"), batch.column("th"), pa.array(list(map(len, sets)), pa.int64()), pa.array(node, pa.binary()), lists, pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "node", "tiles", "bits"])

    kind = items.schema["doc_id"].dataType.simpleString()
    return items.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, {schema}")


def _representatives(full: DataFrame) -> DataFrame:
    """``full`` with one row of each node (or several equal ones)."""
    copies = full.groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "th")).alias("_one"))
    copies = materialise(copies.where("_n > 1").select("_node", "_one"), "jaccard-copies")
    few = copies._palaver_rows <= BROADCAST_ROWS
    joined = full.join(F.broadcast(copies) if few else copies, F.col("node") == F.col("_node"), "left")
    one = F.col("_node").isNull() | (F.col("doc_id").eqNullSafe(F.col("_one.doc_id")) & (F.col("th") == F.col("_one.th")))
    return joined.where(one).drop("_node", "_one")


def _met(one: DataFrame) -> DataFrame:
    """(a, b): hubs and the other members of their tiles, by node, once each.

    Tiles are dealt with 64-bit names of the nodes; a clash of names adds a comparison at most.
    """
    name = lambda node: F.xxhash64(node)
    placed = one.select(F.explode("tiles").alias("tile"), name("node").alias("k"))
    sizes = materialise(placed.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "jaccard-tiles")
    shared = materialise(placed.join(sizes, "tile"), "jaccard-shared")
    degree = shared.groupBy("k").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degree, "k").groupBy("tile").agg(F.max(F.struct("degree", "k"))["k"].alias("hub"))
    pairs = shared.join(hubs, "tile").where("k != hub").groupBy("hub", "k").agg(F.lit(1).alias("_one"))
    pairs = materialise(pairs.select("hub", "k"), "jaccard-pairs", rows=shared._palaver_rows, width=16)
    named = one.select("node").distinct().select("node", name("node").alias("_k"))
    named = materialise(named, "jaccard-names")
    a, b = named.select(F.col("node").alias("a"), F.col("_k").alias("hub")), named.select(F.col("node").alias("b"), F.col("_k").alias("k"))
    met = materialise(pairs.join(b, "k").join(a, "hub").where("a != b").select("a", "b"), "jaccard-met", rows=2 * pairs._palaver_rows, width=32)
    forget(sizes, shared, pairs, named)
    return met


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose bitmaps allow ``percent``."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    # the member's bitmap travels first, so a hub's is not copied through a shuffle
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [differing_bits(x.as_py(), y.as_py()) for x, y in zip(batch.column("bits_a"), batch.column("bits_b"))]
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            ok = can_link(*n, np.array(bits, np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a binary, b binary")


def _size_band(n: Column, percent: int, reach: int) -> Column:
    lows = _lows(percent, reach)
    return F.aggregate(F.lit(lows.tolist()), F.lit(-1), lambda at, low: F.when(low <= n, at + 1).otherwise(at))


def _block_pairs(members: DataFrame, nodes: DataFrame, percent: int, reach: int) -> DataFrame:
    """(a, b): far members with members of other components that the bitmaps allow, in blocks.

    members: hub, node, comp, far, n.
    """
    held = members.join(nodes.select("node", "bits"), "node")
    own = _size_band(F.col("n"), percent, reach)
    every = held.withColumn("band", own)
    far = held.where("far").withColumn("band", F.explode(F.sequence(own - 1, own + 1)))
    count = lambda df, name: df.groupBy("hub", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = count(every, "x_blocks").join(count(far, "y_blocks"), ["hub", "band"])
    blocks = materialise(blocks, "jaccard-blocks", rows=members._palaver_rows, width=40)

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("node", F.lit("block")), F.col(f"{mine}_blocks")).alias(mine)
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        # new columns, for both sides of the cogroup stem from the same ones
        return df.join(blocks, ["hub", "band"]).select(*[F.col(c).alias(c) for c in ("hub", "band", "node", "comp", "n", "bits")], at, each)

    def compared(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for node, comp, n, bits in zip(y["node"], y["comp"], y["n"], y["bits"]):
            other = x[(x["comp"] != comp).to_numpy()]
            apart = np.array([differing_bits(bits, b) for b in other["bits"]], np.int64)
            ok = can_link(other["n"].to_numpy(), np.int64(n), apart, percent) if len(other) else []
            out += [(min(node, m), max(node, m)) for m in other["node"][ok]]
        return pd.DataFrame(out, columns=["a", "b"])

    keys = ["hub", "band", "x", "y"]
    pairs = dealt(every, "x", "y").groupBy(*keys).cogroup(dealt(far, "y", "x").groupBy(*keys)).applyInPandas(compared, "a binary, b binary")
    return pairs.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")


def _later_pairs(met: DataFrame, seen: DataFrame, comps: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """(a, b) of different components in one hub's group that no bound excludes; None where no group is open."""
    comp = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"comp_{name}"))
    members = met.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    members = members.withColumn("comp", F.coalesce("comp_b", "b")).withColumn("out", F.coalesce("comp_a", "a") != F.col("comp"))
    members = members.select("a", "b", "comp", "out")
    groups = members.groupBy("a").agg(F.max("out").alias("open"), F.count(F.lit(1)).alias("size")).where("open and size > 1")
    groups = materialise(groups.select("a"), "jaccard-groups", rows=met._palaver_rows, width=32)
    if not groups._palaver_rows:
        return None
    members = members.join(groups, "a", "left_semi").join(seen, ["a", "b"], "left")
    members = members.join(nodes.select(F.col("node").alias("b"), "n"), "b")
    members = materialise(members, "jaccard-members", rows=met._palaver_rows, width=400)
    pairs = _by_difference(members.where("overlap is not null"), percent)
    far = members.select(F.col("a").alias("hub"), F.col("b").alias("node"), "comp", F.col("overlap").isNull().alias("far"), "n")
    far._palaver_rows = members._palaver_rows
    most = far.agg(F.max(F.when(F.col("far"), F.col("n")))).first()[0]
    if most is not None:
        pairs = pairs.unionByName(_block_pairs(far, nodes, percent, 2 * most))
    pairs = pairs.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")
    pairs = materialise(pairs, "jaccard-later")
    forget(groups, members)
    return pairs


def linked_nodes(items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """items (doc_id, th, text), equal keys having equal texts: (doc_id, th, n, node) of every row, and (node, comp) of linked nodes."""
    key = ["doc_id", "th"]
    rows = materialise(sketches(items, k, percent), "jaccard-sketch")
    # one row of each node, so that no join by node meets a group of copies
    one = _representatives(rows.where("node is not null"))
    met = _met(one)
    ends = met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct()
    nodes = one.select("node", "n", "bits").join(ends, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialise(nodes, "jaccard-nodes", rows=min(2 * met._palaver_rows, rows._palaver_rows), width=1000)
    star = materialise(_bounded(met, nodes, min(STAR, percent)), "jaccard-star", rows=met._palaver_rows, width=32)
    sets = lambda pairs, known=None: _needed(items, one, pairs, known, k, key)
    first_sets = materialise(sets(star), "jaccard-sets", rows=min(2 * star._palaver_rows, nodes._palaver_rows), width=4000)
    seen = materialise(_verified(star, first_sets), "jaccard-seen", rows=star._palaver_rows, width=1000)
    close = lambda pairs: pairs.where(_linked(F.col("n_a"), F.col("n_b"), F.col("overlap"), percent)).select("a", "b")
    comps = materialise(components(close(seen), most=star._palaver_rows), "jaccard-first", rows=2 * star._palaver_rows)
    later = _later_pairs(met, seen, comps, nodes, percent)
    if later is not None and later._palaver_rows:
        later = materialise(_bounded(later, nodes, percent), "jaccard-bounded", rows=later._palaver_rows, width=32)
        more = sets(later, first_sets)
        linked = close(_verified(later, first_sets.unionByName(more)))
        found = comps.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(linked)
        comps = materialise(components(found), "jaccard-comps", rows=2 * (comps._palaver_rows + later._palaver_rows))
        forget(later)
    forget(met, star, seen, first_sets, nodes)
    out = rows.select(*key, "n", "node")
    out._palaver_rows = rows._palaver_rows
    return out, comps


def _needed(items: DataFrame, one: DataFrame, pairs: DataFrame, known: DataFrame | None, k: int, key: list[str]) -> DataFrame:
    """(node, hashes) of the nodes of ``pairs`` that are not ``known``."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if known is not None:
        ends = ends.join(known.select("node"), "node", "left_anti")
    return _sets(items, one.select(*key, "node"), ends, k, key)


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and component_size, one row for each row of ``docs``.

    component_id: the smallest doc_id that links reach, itself included.
    """
    items = docs.select("doc_id", row_hash().alias("th"), "text")
    rows, comps = linked_nodes(items, k, percent)
    number = rows._palaver_rows
    rows = rows.withColumn("id_null", F.col("doc_id").isNull())
    rows._palaver_rows = number
    got = label(rows, comps, ["id_null", "doc_id", "th"])
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("group_size").alias("component_size"))
