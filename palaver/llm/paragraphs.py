"""Repeated passages: near-duplicate paragraphs by MinHash banding.

Paragraphs are the \n-separated lines of a text with at least ``MIN_WORDS`` words, as sets
of 5-word shingles. Bands are tuned for high recall at the threshold; colliding paragraphs
are joined by way of their bucket's leader, verified by exact Jaccard similarity, and
clustered by connected components (see ``neardup``). The first paragraph of a cluster, by
doc_id and place, stays; the others are to be removed.

Defined results: a null or empty text has no paragraph of that size. A null doc_id comes
last. Repeated rows (equal doc_id and text) give equal rows, of which all that tie for the
first stay. Extra columns pass through ``remove_repeats`` untouched.

``passages`` finds what lines cannot show: every run of ``RUN`` words that stands word for
word in two or more documents, over line breaks and inside otherwise different lines. Of each
``RUN - SEED + 1`` successive shingles of ``SEED`` words the least hash is picked (winnowing),
so documents that share a run share its pick. Only runs whose pick is in another document go
on, and are compared by the hash of the whole run. Rows of equal doc_id and text are one
document there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import forget, materialise, row_hash, small_batches
from palaver.llm.neardup import PERCENT, SKETCH, Banding, Shingler, _mix, label, near_groups, sketched

MIN_WORDS = 40
SHINGLE = 5
#: Most acceptable probability that a pair at the threshold shares no band.
MISS = 1e-4
#: Words of a run that counts as a passage, and of the shingles that it is found by.
RUN, SEED = 50, 25
_BASE = 0x9E3779B97F4A7C15
#: Paragraphs that are sketched together.
_TOGETHER = 256


def tuned(percent: int = PERCENT, rows: int = 3, miss: float = MISS) -> Banding:
    """The fewest bands of ``rows`` rows that miss a pair at the threshold no more often than ``miss``."""
    bands = 1
    while Banding(rows, bands).missed(percent / 100) > miss:
        bands += 1
    return Banding(rows, bands, prune=False)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, text) of all paragraphs."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "text")
    return docs.select("doc_id", row_hash().alias("th"), lines)


def paragraph_sketches(docs: DataFrame, min_words: int, banding: Banding) -> DataFrame:
    """(doc_id, th, pos, n, node, bands, sig) of the paragraphs with enough words."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(SHINGLE)
        names = ["doc_id", "th", "pos", "n", "node", "bands", "sig"]

        def made(batch: pa.RecordBatch, row: list[int], pos: list[int], held: list[bytes]) -> pa.RecordBatch:
            own = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "th")]
            return pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int32()), *sketched(shingles.many(held), banding)], names=names)

        for batch in batches:
            row, pos, held = [], [], []
            for i, text in enumerate(batch.column("text")):
                for j, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if len(line) >= 2 * min_words - 1 and len(line.split()) >= min_words:
                        row.append(i)
                        pos.append(j)
                        held.append(line)
                        if len(held) == _TOGETHER:
                            yield made(batch, row, pos, held)
                            row, pos, held = [], [], []
            if held:
                yield made(batch, row, pos, held)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_hash().alias("th"), "text").mapInArrow(run, f"doc_id {id_type}, th long, pos int, {SKETCH}")


def repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every paragraph that has a near copy: doc_id, th, paragraph, n_shingles, its group's first
    (group_doc_id, group_paragraph), the group's size and ``kept``."""
    banding = tuned(percent)
    sketch = paragraph_sketches(docs, min_words, banding)
    rows, comps = near_groups(paragraphs(docs), ["doc_id", "th", "pos"], SHINGLE, percent, banding, sketch)
    # only linked or exactly repeated paragraphs go on
    many = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("node")
    wanted = materialise(many.unionByName(comps.select("node")).distinct(), "paragraph-nodes", rows=rows._palaver_rows, width=32)
    number = rows._palaver_rows
    rows = rows.join(wanted, "node", "left_semi").withColumn("id_null", F.col("doc_id").isNull())
    rows._palaver_rows = number
    got = label(rows, comps, ["id_null", "doc_id", "th", "pos"]).where("group_size > 1")
    first = F.col("first")
    kept = F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("th") == first["th"]) & (F.col("pos") == first["pos"])
    return got.select(
        "doc_id",
        "th",
        F.col("pos").cast("long").alias("paragraph"),
        F.col("n").alias("n_shingles"),
        first["doc_id"].alias("group_doc_id"),
        first["pos"].cast("long").alias("group_paragraph"),
        "group_size",
        kept.alias("kept"),
    )


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the paragraphs to be removed; null texts stay null."""
    names = docs.columns
    gone = repeats(docs, **options).where("not kept").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_h"))
    gone = gone.agg(F.collect_set(F.col("paragraph").cast("int")).alias("_gone"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    packed = packed.withColumn("_h2", row_hash(F.col("_row.text")))
    by = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h2") == F.col("_h"))
    joined = packed.join(gone, by, "left").withColumn("_lines", F.split("_row.text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    out = {c: F.col(f"_row.`{c}`") for c in names}
    out["text"] = F.when(F.col("_gone").isNull(), out["text"]).otherwise(text)
    return joined.select(*[out[c].alias(c) for c in names])


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Runs:
    """The stretches of successive runs of ``RUN`` words of a text that are found by the same shingle."""

    def __init__(self):
        self.words = Shingler(SEED).words

    def __call__(self, text: str | None) -> tuple[np.ndarray, ...] | None:
        """Of each stretch its shingle, a hash of its words, and its first run and their number; last
        a function from a stretch to its runs' hashes. None for a text of fewer words."""
        ids = self.words(text)
        n = len(ids)
        if n < RUN:
            return None
        power, inverse = _powers(1 << max(n - 1, 1).bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * power[:n], out=sums[1:])
        least, width = _mix((sums[SEED:] - sums[:-SEED]) * inverse[: n - SEED + 1]), 1
        while width < RUN - SEED + 1:  # minima of windows, by doubling
            step = min(width, RUN - SEED + 1 - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(least[1:] != least[:-1]) + 1])
        many = np.diff(first, append=len(least))
        whole = _mix((sums[first + many + RUN - 1] - sums[first]) * inverse[first] + many.astype(np.uint64))

        def runs(i: int) -> np.ndarray:
            at = np.arange(first[i], first[i] + many[i])
            return _mix((sums[at + RUN] - sums[at]) * inverse[at] + np.uint64(1)).view(np.int64)

        return least[first].view(np.int64), whole.view(np.int64), first, many, runs


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for batch in batches:
        keys, seeds, wholes = [], [], []
        for key, text in zip(batch.column("dk").to_pylist(), batch.column("text")):
            if got := runs(text.as_py()):
                keys.append(np.full(len(got[0]), key))
                seeds.append(got[0])
                wholes.append(got[1])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, seeds, wholes)], names=["dk", "seed", "whole"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Runs()
    for batch in batches:
        rows, run, pos, many = [], [], [], []
        for i, (text, alike, mixed) in enumerate(zip(batch.column("text"), batch.column("alike"), batch.column("mixed"))):
            seeds, whole, first, number, runs = finder(text.as_py())
            at = np.flatnonzero(np.isin(seeds, alike.values.to_numpy()))
            parts = np.flatnonzero(np.isin(seeds, mixed.values.to_numpy()))
            run += [whole[at], *map(runs, parts)]
            pos += [first[at], *(np.arange(first[j], first[j] + number[j]) for j in parts)]
            single = int(number[parts].sum())
            many += [number[at], np.ones(single, np.int64)]
            rows.append(np.full(len(at) + single, i))
        if rows:
            own = [batch.column(c).take(pa.array(np.concatenate(rows))) for c in ("doc_id", "th")]
            own += [pa.array(np.concatenate(run)), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (pos, many))]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "th", "run", "pos", "many"])


def passages(docs: DataFrame) -> DataFrame:
    """The longest stretches of runs that two or more documents share: doc_id, th, place of the first
    word (start), n_words, the same of the first document that has it (group_doc_id, group_start),
    the number of places of its most frequent run (group_size) and ``kept``."""
    small_batches(docs.sparkSession, 1000)
    keyed = docs.select("doc_id", row_hash().alias("th"), "text").withColumn("dk", F.xxhash64("doc_id", "th", F.col("doc_id").isNull()))
    seeds = materialise(keyed.select("dk", "text").mapInArrow(_seeds, "dk long, seed long, whole long"), "passage-seeds")
    # where all stretches of a shingle are the same words they go on as one, else run by run
    shared = seeds.groupBy("seed").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("dk", "whole") for f in (F.min, F.max)])
    shared = shared.where("min_dk != max_dk").select("seed", (F.col("min_whole") == F.col("max_whole")).alias("_alike"))
    lists = [F.collect_set(F.when(c, F.col("seed"))).alias(n) for c, n in ((F.col("_alike"), "alike"), (~F.col("_alike"), "mixed"))]
    wanted = materialise(seeds.select("dk", "seed").join(shared, "seed").groupBy("dk").agg(*lists), "passage-wanted")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = keyed.join(wanted, "dk").select("doc_id", "th", "text", "alike", "mixed")
    found = materialise(found.mapInArrow(_candidates, f"doc_id {id_type}, th long, run long, pos int, many int"), "passage-runs")
    forget(seeds, wanted)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("id_null"), "doc_id", "th", "pos"))
    most = F.max(F.struct(F.col("doc_id").isNull().alias("id_null"), "doc_id", "th"))
    groups = found.groupBy("run").agg(least.alias("first"), most.alias("last"), F.count(F.lit(1)).alias("size"))
    groups = groups.where(~(F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("first.th") == F.col("last.th"))))
    groups = groups.select("run", F.col("first.doc_id").alias("group_doc_id"), F.col("first.th").alias("group_th"), F.col("first.pos").alias("_at"), "size")
    # written first, so that both sides of the join are plain shuffles and a hot run can be split
    groups = materialise(groups, "passage-groups", rows=found._palaver_rows, width=48)
    places = found.join(groups, "run").withColumn("shift", F.col("pos") - F.col("_at")).withColumn("end", F.col("pos") + F.col("many")).drop("run", "_at", "many")
    doc = ["doc_id", "th", "group_doc_id", "group_th", "shift"]
    before = Window.partitionBy(*doc).orderBy("pos")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("_new", F.coalesce(F.col("pos") > reached, F.lit(True)).cast("int"))
    places = places.withColumn("_island", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    got = places.groupBy(*doc, "_island").agg(F.min("pos").alias("start"), (F.max("end") - 1).alias("end"), F.max("size").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("group_doc_id")) & (F.col("th") == F.col("group_th"))
    return got.select(
        "doc_id",
        "th",
        F.col("start").cast("long").alias("start"),
        (F.col("end") - F.col("start") + RUN).cast("long").alias("n_words"),
        "group_doc_id",
        (F.col("start") - F.col("shift")).cast("long").alias("group_start"),
        "group_size",
        (kept & (F.col("shift") == 0)).alias("kept"),
    )
