"""Near-duplicates by MinHash banding with sequential Bayesian verification.

An item (document, paragraph) is the set of its distinct word shingles. Equal sets are
one node, named by a 128-bit digest. Nodes that agree on all rows of a band meet in a
bucket; the bucket's leader is the node that meets the most others over all its buckets,
usually the text that its near copies stem from.

1. Star: every member is paired with its leaders. Signatures are compared batch by batch;
   with a uniform prior the similarity given m of n agreements is Beta(m + 1, n - m + 1),
   and a pair goes once P(similarity >= bound) falls below ``MISS``. Survivors are verified
   on the full sets, which also gives the exact overlap with the leader. Here the bound lies
   below the threshold, so overlaps are known for all but far members.
2. Components of the links so far. A member that is in its leader's component needs no
   further comparison inside the bucket. What is left are outsiders.
3. Outsiders meet the other members of a leader's group only where a link is possible. Let
   d(x) be the symmetric difference of x and the leader. x and y link only if d(x) and d(y)
   share at least (|d(x)| + |d(y)| - (|x| + |y|) / 9) / 2 shingles (at 80 percent), so with
   the differences ordered from rare to frequent within the group, short prefixes must meet,
   early enough that what follows can still suffice (prefix and positional filters, exact).
   Far members, whose difference is not known, meet others by size; they cannot link to
   members close to the leader (triangle inequality of the Jaccard distance). The surviving
   pairs are pruned and verified as before, with the bound at the threshold.

So a group of near copies costs one comparison per member and bucket leader, not one per
pair, and every pair of nodes that shares a bucket is either verified, excluded by a bound
or already connected.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import forget, lean, materialise, row_hash, small_batches
from palaver.llm.components import components

#: Most rows of a chosen table that are broadcast: measured at 190 bytes a row (node, key columns
#: and the hash table), 38 MB at most; beyond, the join shuffles. Results are equal.
BROADCAST_ROWS = 200_000
#: Agreements are counted on so many 16-bit hashes, in batches of so many.
SIGNATURE, BATCH = 128, 16
#: Chosen miss probability of a Bayesian prune.
MISS = 1e-6
#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Similarity bound of the star's prune, in percent.
STAR_PERCENT = 55
#: Geometric width of the size classes that outsiders are matched by.
SIZE_STEP = 1.03
#: Hashes of words that a task keeps (about 150 bytes each).
_WORDS_KEPT = 200_000
#: Shingles of a block of texts that are sketched together.
_BLOCK = 1 << 14


@dataclass(frozen=True)
class Banding:
    """Rows of a band, bands, and whether signatures are kept for the sequential prune."""

    rows: int
    bands: int
    prune: bool = True

    def missed(self, similarity: float) -> float:
        """Probability that a pair shares no band."""
        return (1 - similarity**self.rows) ** self.bands


#: Misses a pair at similarity 0.8 with probability 2e-5; one at 0.1 meets with 4e-5.
DOCUMENTS = Banding(6, 36)


class Shingler:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    Words are runs of other characters than ASCII white space, A-Z lower-cased. A text with
    fewer words than k is one shingle; one without words is the empty set.
    """

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def words(self, text: str | bytes | None) -> np.ndarray:
        """Hashes of the words, in order."""
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > _WORDS_KEPT:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, 7)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        h = self.words(text)
        return np.unique(_shingles(h, min(self.k, len(h)))) if len(h) else h

    def many(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        """The same of each text, for many short texts at once."""
        ids = [self.words(t) for t in texts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        out = [np.unique(_shingles(h, len(h))) if 0 < len(h) < self.k else h[:0] for h in ids]
        long = np.flatnonzero(size >= self.k)
        if len(long):
            h = np.concatenate([ids[i] for i in long])
            size = size[long]
            of = np.repeat(np.arange(len(long)), size)
            hashes = _shingles(h, self.k)
            inside = of[: len(hashes)] == of[self.k - 1 :]
            of, hashes = of[: len(hashes)][inside], hashes[inside]
            order = np.lexsort((hashes, of))
            of, hashes = of[order], hashes[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
            of, hashes = of[new], hashes[new]
            for i, part in zip(long, np.split(hashes, np.searchsorted(of, np.arange(1, len(long))))):
                out[i] = part
        return out


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k of the hashes ``h``."""
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


@functools.cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    multiply = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
    return multiply, rng.integers(0, 2**32, n, dtype=np.uint32)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """[set, permutation]: the minima of each set (none is empty)."""
    multiply, flip = _constants(n)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum(size) - size
    out = np.empty((n, len(sets)), np.uint32)
    for j in range(n):
        np.minimum.reduceat((low ^ flip[j]) * multiply[j], start, out=out[j])
    return np.ascontiguousarray(out.T)


def band_keys(mins: np.ndarray, banding: Banding) -> np.ndarray:
    """[set, band]"""
    by_band = mins.reshape(len(mins), banding.bands, banding.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(banding.bands, dtype=np.uint64) + np.uint64(1), by_band.shape[:2])
    for r in range(banding.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + by_band[:, :, r])
    return key.view(np.int64)


def signatures(mins: np.ndarray) -> list[bytes]:
    short = (mins[:, :SIGNATURE] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
    return [row.tobytes() for row in short]


@functools.cache
def least_agreements(percent: int) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ...: the agreements below which a pair goes.

    P(similarity >= s | m of n) under a uniform prior is the binomial tail
    P(Bin(n + 1, s) <= m), from the identity of beta and binomial distributions.
    """
    s, out = percent / 100, []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        out.append(m)
    return tuple(out)


def plausible(a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of signatures survive the sequential prune."""
    x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, SIGNATURE)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, SIGNATURE)
    alive, agreed = np.arange(len(x)), np.zeros(len(x), np.int64)
    for step, least in enumerate(least_agreements(percent)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        agreed = agreed + (x[alive, part] == y[alive, part]).sum(axis=1)
        ok = agreed >= least
        alive, agreed = alive[ok], agreed[ok]
    return alive


def _batched(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)


def _blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the sets that are not empty, in blocks of about ``_BLOCK`` elements."""
    full = np.flatnonzero(sizes)
    block = (np.cumsum(sizes[full]) - 1) // _BLOCK
    yield from np.split(full, np.flatnonzero(np.diff(block)) + 1) if len(full) else ()


def sketched(sets: list[np.ndarray], banding: Banding) -> list[pa.Array]:
    """Columns n, node, bands and sig of the sets."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    node = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
    bands, sig = np.zeros((len(sets), banding.bands), np.int64), [None] * len(sets)
    for at in _blocks(size):
        mins = minhashes([sets[i] for i in at], banding.rows * banding.bands)
        bands[at] = band_keys(mins, banding)
        if banding.prune:
            for i, row in zip(at, signatures(mins)):
                sig[i] = row
    ends = np.concatenate([[0], np.cumsum(np.where(size > 0, banding.bands, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[size > 0].ravel()))
    return [pa.array(size), pa.array(node, pa.binary()), lists, pa.array(sig, pa.binary())]


SKETCH = "n long, node binary, bands array<long>, sig binary"


def sketches(items: DataFrame, k: int, banding: Banding) -> DataFrame:
    """items (text and others): the others with n (size of the set), node, bands and sig.

    Empty sets have a null node and no bands.
    """
    others = [f for f in items.schema if f.name != "text"]
    small_batches(items.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column("text")]
            got = [batch.column(f.name) for f in others] + sketched(sets, banding)
            yield pa.RecordBatch.from_arrays(got, names=[f.name for f in others] + ["n", "node", "bands", "sig"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    order = items.select(*[f"`{f.name}`" for f in others], "text")
    return order.mapInArrow(lean(run), f"{ddl}, {SKETCH}")


def _plausible_pairs(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, ...) whose signatures survive, one map over Arrow batches."""
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    joined = pairs.join(left, "a").join(right, "b")
    kept = [c for c in joined.columns if c not in ("sig_a", "sig_b")]
    joined = joined.select(*kept, "sig_a", "sig_b")

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = plausible(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist(), percent)
                yield batch.select(kept).take(pa.array(alive, pa.int64()))

    return joined.mapInArrow(lean(pruned), joined.select(*kept).schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a, n_b, overlap, and ``diff``: the hashes that one of them lacks.

    ``sets``: (node, hashes). The set of b travels first, that of a last, so the set of a
    leader with many members is not copied through a shuffle.
    """
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("overlap", pa.int64()), ("diff", pa.list_(pa.int64()))])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, overlap, diff = [], [], [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(x, y)
                both = x[np.minimum(at, len(x) - 1)] == y
                n_a.append(len(x))
                n_b.append(len(y))
                overlap.append(int(both.sum()))
                lost = np.ones(len(x), bool)
                lost[at[both]] = False
                diff.append(np.concatenate([x[lost], y[~both]]).view(np.int64))
            yield _batched([batch.column("a"), batch.column("b"), n_a, n_b, overlap, diff], schema)

    return joined.mapInArrow(lean(compared), "a binary, b binary, n_a long, n_b long, overlap long, diff array<long>")


def _sets(items: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, key: list[str]) -> DataFrame:
    """(node, hashes) of ``nodes``: the full sets, from one item's text each."""
    chosen = rows.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*key)).alias("_one"))
    chosen = materialise(chosen, "near-chosen")
    few = chosen._palaver_rows <= BROADCAST_ROWS
    chosen = chosen.select("node", *[F.col(f"_one.`{c}`").alias(f"_{c}") for c in key])
    by = functools.reduce(lambda x, y: x & y, [items[c].eqNullSafe(chosen[f"_{c}"]) for c in key])
    if few:
        chosen = F.broadcast(chosen)
    texts = items.join(chosen, by).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    return texts.mapInArrow(lean(_hashed(k)), "node binary, hashes binary")


def _hashed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            hashes = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    return run


def _linked(n_a: Column, n_b: Column, overlap: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(math.log(SIZE_STEP)))


def near_groups(
    items: DataFrame, key: list[str], k: int, percent: int = PERCENT, banding: Banding = DOCUMENTS, sketch: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """items: (*key, text), equal keys having equal texts; ``sketch``: their ``sketches``, if
    already made (``items`` may then have other rows besides).

    Returns the sketched rows (*key, n, node) and (node, comp) of the linked nodes. The first
    has ``_palaver_rows``, the number of rows.
    """
    rows = materialise(sketch if sketch is not None else sketches(items, k, banding), "near-sketch")
    number = rows._palaver_rows
    full = rows.where("node is not null")
    nodes = full.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "near-nodes", rows=number, width=300 + 8 * banding.bands)
    sigs = nodes.select("node", "sig")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(placed.join(sizes, "bucket"), "near-shared", rows=nodes._palaver_rows * banding.bands, width=32)
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    chief = F.max(F.struct("degree", "node"))["node"].alias("a")
    leaders = shared.join(degree, "node").groupBy("bucket").agg(chief)
    met = shared.join(leaders, "bucket").where("node != a").select("a", F.col("node").alias("b"))
    met = materialise(met.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b"), "near-met", rows=shared._palaver_rows, width=32)
    forget(shared)

    star = met
    if banding.prune:
        star = materialise(_plausible_pairs(met, sigs, min(STAR_PERCENT, percent)), "near-star", rows=met._palaver_rows, width=32)
    pairs = star._palaver_rows
    needed = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    sets = materialise(_sets(items, rows.select(*key, "node"), needed, k, key), "near-sets", rows=min(2 * pairs, nodes._palaver_rows), width=4000)
    seen = materialise(_verified(star, sets), "near-seen", rows=pairs, width=1000)
    links = seen.where(_linked(F.col("n_a"), F.col("n_b"), F.col("overlap"), percent)).select("a", "b")
    first = materialise(components(links, most=pairs), "near-first", rows=2 * pairs)

    more = _outsider_pairs(met, seen, first, nodes.select("node", "n"), percent)
    late = materialise(_plausible_pairs(more, sigs, percent) if banding.prune else more, "near-more")
    found = first
    if late._palaver_rows:
        ends = late.select(F.col("a").alias("node")).unionByName(late.select(F.col("b").alias("node"))).distinct()
        lacking = materialise(ends.join(sets.select("node"), "node", "left_anti"), "near-lacking", rows=2 * late._palaver_rows, width=32)
        every = sets
        if lacking._palaver_rows:
            every = sets.unionByName(_sets(items, rows.select(*key, "node"), lacking, k, key))
        linked = _verified(late, every).where(_linked(F.col("n_a"), F.col("n_b"), F.col("overlap"), percent)).select("a", "b")
        most = first._palaver_rows + late._palaver_rows
        all_links = first.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(linked)
        found = materialise(components(all_links, most=most), "near-comps", rows=2 * most)
        forget(lacking, first)
    forget(met, star, sets, seen, nodes, late, more._palaver_members)
    out = rows.select(*key, "n", "node")
    out._palaver_rows = number
    return out, found


def _outsider_pairs(met: DataFrame, seen: DataFrame, comps: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components in one leader's group that no bound excludes."""
    comp = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"comp_{name}"))
    members = met.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    members = members.withColumn("comp", F.coalesce("comp_b", "b"))
    members = members.withColumn("out", F.coalesce("comp_a", "a") != F.col("comp"))
    groups = members.groupBy("a").agg(F.max("out").alias("open"), F.count(F.lit(1)).alias("size")).where("open and size > 1")
    members = members.select("a", "b", "comp", "out").join(groups.select("a"), "a", "left_semi")
    members = members.join(seen, ["a", "b"], "left").join(sizes.select(F.col("node").alias("b"), "n"), "b")
    members = materialise(members, "near-members", rows=met._palaver_rows, width=400)
    pairs = _by_difference(members.where("overlap is not null"), percent).unionByName(_by_size(members, percent))
    out = pairs.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")
    out._palaver_members = members  # for ``forget``
    return out


def _by_difference(near: DataFrame, percent: int) -> DataFrame:
    """Pairs of members with known differences, by prefix and positional filters."""
    slack = (100 - percent) / (100 + percent)
    near = near.withColumn("d", F.size("diff"))
    tokens = near.select("a", "b", F.explode("diff").alias("h"))
    often = tokens.groupBy("a", "h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = tokens.join(often, ["a", "h"]).join(near.select("a", "b", "comp", "out", "n", "n_a", "d"), ["a", "b"])
    member = Window.partitionBy("a", "b")
    # shingles that no other member has come first and are not carried along
    place = F.col("d") - F.count(F.lit(1)).over(member) + F.row_number().over(member.orderBy("df", "h")) - 1
    held = held.withColumn("left", F.col("d") - place)
    # least overlap with any outsider, and of an outsider with any member
    of_x = (F.col("d") + slack * (F.col("n_a") - F.col("n"))) / 2
    of_y = (F.col("d") - slack * (F.col("n_a") + F.col("n"))) / 2
    least = lambda c: F.greatest(F.lit(1), F.ceil(c - 1e-9))
    cols = ("b", "comp", "out", "n", "d", "left")
    x = held.where(F.col("left") >= least(of_x)).select("a", "h", *[F.col(c).alias(f"x_{c}") for c in cols])
    y = held.where("out").where(F.col("left") >= least(of_y)).select("a", "h", *[F.col(c).alias(f"y_{c}") for c in cols])
    needed = (F.col("x_d") + F.col("y_d") - slack * (F.col("x_n") + F.col("y_n"))) / 2 - 1e-9
    fits = (F.col("x_comp") != F.col("y_comp")) & (F.least("x_left", "y_left") >= needed)
    return y.join(x, ["a", "h"]).where(fits).select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b"))


def _by_size(members: DataFrame, percent: int) -> DataFrame:
    """Pairs with a far member, by size classes and the triangle inequality."""
    far = F.col("overlap").isNull()
    jaccard = F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))
    m = members.select("a", "b", "comp", "out", "n", jaccard.alias("j"), far.alias("far"))
    low = _size_class(F.greatest(F.col("n") * (percent / 100) - 1, F.lit(1)))
    classes = F.explode(F.sequence(low, _size_class(F.col("n") * (100 / percent) + 1)))
    cols = ("b", "comp", "out", "n", "j", "far")
    y = m.where("out").withColumn("c", classes).select("a", "c", *[F.col(x).alias(f"y_{x}") for x in cols])
    x = m.withColumn("c", _size_class(F.col("n"))).select("a", "c", *[F.col(x).alias(f"x_{x}") for x in cols])
    close = (STAR_PERCENT + 100 - percent) / 100
    apart = lambda p, q: F.col(f"{p}_far") & (F.coalesce(F.col(f"{q}_j"), F.lit(0.0)) > close)
    fits = (
        (F.col("x_comp") != F.col("y_comp"))
        & _linked(F.col("x_n"), F.col("y_n"), F.least("x_n", "y_n"), percent)
        & ~apart("x", "y")
        & ~apart("y", "x")
    )
    ends = (F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b"))
    with_far = y.join(x.where("x_far"), ["a", "c"]).where(fits).select(*ends)
    of_far = y.where("y_far").join(x.where("not x_far"), ["a", "c"]).where(fits).select(*ends)
    return with_far.unionByName(of_far)


def label(rows: DataFrame, comps: DataFrame, order: list[str]) -> DataFrame:
    """rows (..., node) with ``first``: the least struct of ``order`` in the row's group.

    A row without a node is its own group. The firsts are written before they are joined, so
    that both sides of each join are plain shuffles, in which a hot group can be split.
    """
    alone = F.struct(*order)
    marked = rows.join(comps.select("node", F.col("comp").alias("_c")), "node", "left")
    marked = marked.withColumn("comp", F.coalesce("_c", "node")).drop("_c")
    least = marked.where("comp is not null").groupBy("comp").agg(F.min(alone).alias("_least"), F.count(F.lit(1)).alias("_size"))
    least = materialise(least.where("_size > 1"), "near-least", rows=getattr(rows, "_palaver_rows", None))
    joined = marked.join(least, "comp", "left").withColumn("first", F.coalesce("_least", alone))
    return joined.withColumn("group_size", F.coalesce("_size", F.lit(1))).drop("_least", "_size")


def near_documents(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and kept, one for each row of ``docs``.

    Repeated rows (equal doc_id and text) give equal rows. The first of a group is the smallest
    doc_id (a null id last, then the smaller th); it is kept. Null and empty texts, and texts
    without words, are linked with nothing. An empty table gives no row.
    """
    items = docs.select("doc_id", row_hash().alias("th"), "text")
    rows, comps = near_groups(items, ["doc_id", "th"], k, percent)
    number = rows._palaver_rows
    rows = rows.withColumn("id_null", F.col("doc_id").isNull())
    rows._palaver_rows = number
    got = label(rows, comps, ["id_null", "doc_id", "th"])
    # the contract's kept: the row's id is its component's; for null ids the text's hash decides
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_id").isNotNull() | (F.col("th") == F.col("first.th")))
    got = got.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), kept.alias("kept"))
    got._palaver_rows = number
    return got


def keep_first(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand first in their group, with all their columns.

    Of repeated rows (equal doc_id and text) one stays.
    """
    names = docs.columns
    found = near_documents(docs, k, percent)
    number = found._palaver_rows
    keyed = found.groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    keyed = materialise(keyed.where("not kept or copies > 1"), "near-gone", rows=number)
    gone = keyed.where("not kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_h"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    packed = packed.withColumn("_id2", F.col("_row.doc_id")).withColumn("_h2", row_hash(F.col("_row.text")))
    if keyed._palaver_rows <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = packed.join(gone, F.col("_id2").eqNullSafe(F.col("_id")) & (F.col("_h2") == F.col("_h")), "left_anti")
    if not keyed.where("kept").isEmpty():
        kept = kept.dropDuplicates(["_id2", "_h2"])
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
