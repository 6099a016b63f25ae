"""Line dedup with levelled sorted runs of line hashes (DataFrame operations only).

A line's key is the line without ASCII white space at either end, A-Z lower-cased.
Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold
lose all their lines except in the document with the largest doc_id.

Documents come in batches of falling doc_id, each read once. A batch is reduced to one row
per key: (key, number of documents, largest doc_id). Its keys that a run has already settled
(``min_docs`` documents reached; being met in falling order, their largest doc_id is final)
are taken out by a sort-merge anti-join with each run in turn; the rest is a new run.
Whenever a level has ``FANOUT`` runs they are merged into one run of the next level, between
batches. A run is a table bucketed and sorted by key, with as many buckets as a shuffle has
partitions, so that neither an anti-join nor a merge shuffles runs: only the batch moves, once.
Runs live below ``spark.checkpoint.dir``, so a lost executor costs only its tasks.

Keys are two 64-bit hashes with different seeds. A key that most documents hold is
summed map-side before its shuffle; the join that marks its lines has one row per key
on the other side, so skewed partitions can be split.

Defined results: a null or empty text is one empty line. Each row is a document, repeated
rows too; a null doc_id is smaller than any other. Rows that tie for the largest doc_id of
a key all keep it. Extra columns pass through ``drop_lines`` untouched.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import ASCII_WS, delete, materialise, row_hash, shared_dir

MIN_CHARS = 20
MIN_DOCS = 3
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Rows of a batch, and the fewest and most batches (of small tables batches are smaller, of very large ones larger).
BATCH_ROWS, MIN_BATCHES, MAX_BATCHES = 60_000, 4, 64
_LOWEST = -(2**63)


def line_key(line: Column) -> Column:
    """Trimmed of ASCII white space, A-Z lower-cased (other letters stay)."""
    bare = F.btrim(line, F.lit(ASCII_WS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, pos, k1, k2, held, batch) of the lines long enough to count.

    ``held`` rows stand for a key of a row, once (pos is -1); the others for a line each.
    With both from one pass, counting documents needs no distinct shuffle.
    """
    keys = F.transform(_lines(F.col("text")), line_key)
    entry = F.transform(
        keys,
        lambda k, i: F.struct(
            i.alias("pos"), F.char_length(k).alias("size"), F.xxhash64(k).alias("k1"), F.xxhash64(F.lit("second"), k).alias("k2")
        ),
    )
    rows = docs.select(F.col("doc_id").alias("id"), row_hash().alias("th"), F.col("_batch").alias("batch"), F.filter(entry, lambda e: e["size"] >= min_chars).alias("e"))

    def tagged(array: Column, pos, held: bool) -> Column:
        return F.transform(array, lambda e: F.struct(pos(e).alias("pos"), e["k1"].alias("k1"), e["k2"].alias("k2"), F.lit(held).alias("held")))

    distinct = F.array_distinct(F.transform("e", lambda e: F.struct(e["k1"].alias("k1"), e["k2"].alias("k2"))))
    both = F.concat(tagged(F.col("e"), lambda e: e["pos"], False), tagged(distinct, lambda e: F.lit(-1), True))
    return rows.where(F.size("e") > 0).select("id", "th", "batch", F.explode(both).alias("l")).select("id", "th", "l.*", "batch")


class RunStore:
    """Levels of sorted runs (k1, k2, n, top); the newest run of a level comes last."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, run: DataFrame, level: int) -> str:
        """``run``, dealt by key already, as a table with a sorted file for each bucket."""
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2")
        writer.option("path", shared_dir(self.spark, name)).saveAsTable(name)
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "k1", "k2")

    def _merge(self, a: str, b: str, level: int) -> str:
        """One run of two, by a full merge join of their buckets; the two are deleted.

        Not by a union: Spark 4.1.2 takes a union of bucketed tables for dealt by key, which it
        is not when it runs, and sums too little.
        """
        left = self.spark.table(a)
        right = self.spark.table(b).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("n").alias("_n"), F.col("top").alias("_top"))
        both = left.hint("merge").join(right, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
        top = F.greatest("top", "_top")  # skips nulls
        out = self._write(both.select(F.coalesce("k1", "_1").alias("k1"), F.coalesce("k2", "_2").alias("k2"), n.alias("n"), top.alias("top")), level)
        self.drop([a, b])
        return out

    def add_batch(self, held: DataFrame) -> None:
        """``held``: one row (k1, k2, id) for each document and key of the batch.

        The ids must not exceed those of earlier batches.
        """
        top = F.max(F.coalesce("id", F.lit(_LOWEST))).alias("top")
        batch = held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), top)
        for name in self.runs():
            settled = self.spark.table(name).where(F.col("n") >= self.min_docs).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"))
            # n keeps the join above the sums: a hot key is summed before it moves
            met = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n") > 0)
            batch = batch.hint("merge").join(settled, met, "left_anti")
        if not self.levels:
            self.levels.append([])
        batch = self._dealt(batch)  # as the sums are dealt already, unless small partitions were merged
        self.levels[0].append(self._write(batch, 0))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(*self.levels[level], level + 1))
            self.levels[level] = []
            level += 1

    def settled(self) -> DataFrame:
        """Keys that ``min_docs`` documents hold, with the largest doc_id: all runs merged, small ones first."""
        runs = self.runs()
        while len(runs) > 1:
            runs = [self._merge(runs[0], runs[1], len(self.levels)), *runs[2:]]
        self.levels = [runs]
        return self.spark.table(runs[0]).where(F.col("n") >= self.min_docs)

    def drop(self, runs: list[str]) -> None:
        """Delete runs that nothing reads any more."""
        for name in runs:
            path = self.spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, path)


def _with_batch(docs: DataFrame, batches: int | None) -> tuple[DataFrame, int]:
    """``docs`` with _batch, ranges of falling doc_id from 0 on (a null id is in the last), and their number."""
    rows = docs.count()
    wanted = max(MIN_BATCHES, min(MAX_BATCHES, rows // BATCH_ROWS)) if batches is None else batches
    marks = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
    cuts = docs.agg(F.percentile_approx("doc_id", marks, F.lit(10_000)).alias("c")).first()["c"] if wanted > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.coalesce(F.col("doc_id") <= cut, F.lit(True))).cast("int")
    return docs.withColumn("_batch", batch), len(cuts) + 1


def find_duplicates(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(id, th, pos) of the lines to drop."""
    marked, number = _with_batch(docs.select("doc_id", "text"), batches)
    lines = keyed_lines(marked, min_chars)
    lines = materialise(lines, "line-keys", partition_by="batch") if number > 1 else materialise(lines, "line-keys")
    store = RunStore(docs.sparkSession, min_docs)
    for i in range(number):
        store.add_batch(lines.where("held").where(F.col("batch") == i).select("id", "k1", "k2"))
    known = materialise(store.settled(), "line-settled")
    store.drop(store.runs())
    gone = lines.where("not held").join(known.select("k1", "k2", "top"), ["k1", "k2"])
    return gone.where(F.coalesce("id", F.lit(_LOWEST)) != F.col("top")).select("id", "th", "pos")


def _rebuilt(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with _lines and _gone (positions to drop; null: none)."""
    gone = find_duplicates(docs, **options)
    # the positions of a row are no more than its lines; equal rows share them
    per_row = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("_gone"))
    left = docs.withColumn("_th", row_hash())
    joined = left.join(per_row, left["doc_id"].eqNullSafe(per_row["id"]) & left["_th"].eqNullSafe(per_row["th"]), "left")
    return joined.drop("id", "th", "_th").withColumn("_lines", _lines(F.col("text")))


def _kept_text() -> Column:
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.array_except(every, F.col("_gone"))
    joined = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return F.when(F.col("_gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(joined)


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """doc_id, kept_text, n_lines (before) and n_dropped, for every row of ``docs``."""
    got = _rebuilt(docs.select("doc_id", "text"), min_chars=min_chars, min_docs=min_docs, batches=batches)
    return got.select(
        "doc_id",
        _kept_text().alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` reduced (null stays null) and n_chars, where present, counted anew."""
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest") if rest else F.lit(0).alias("_rest"))
    got = _rebuilt(packed, **options).withColumn("_text", F.when(F.col("text").isNotNull(), _kept_text()))
    out = {"doc_id": F.col("doc_id"), "text": F.col("_text")} | {c: F.col(f"_rest.`{c}`") for c in rest}
    if "n_chars" in names:
        size = F.char_length(F.col("_text")).cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("_gone").isNull(), out["n_chars"]).otherwise(size)
    return got.select(*[out[c].alias(c) for c in names])
