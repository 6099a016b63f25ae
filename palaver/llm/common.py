"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009..U+000D.
ASCII_WS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a session on one machine gets
    a temporary folder, once; a cluster session raises, for its executors would each write
    to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palaver-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: What ``materialise`` wrote and ``forget`` did not delete, by application.
_WRITTEN: dict[str, set[str]] = defaultdict(set)
#: Aimed-at size of a written file where a bound of the rows is known.
FILE_BYTES = 4 << 20


def materialise(df: DataFrame, label: str, *, rows: int | None = None, width: int = 64, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    ``rows`` is an upper bound of the rows, ``width`` their bytes: a table that must be small
    is written by few tasks, however many partitions it was shuffled to, so that small tables
    do not cost thousands of files. The result's ``_palaver_rows`` has the rows written (no
    fewer than that where tasks were run again). The files stay until ``forget`` or ``release``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    counted = Observation()
    out = df if rows is None else df.coalesce(max(1, -(-rows * width // FILE_BYTES)))
    writer = out.observe(counted, F.count(F.lit(1)).alias("n")).write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _WRITTEN[spark.sparkContext.applicationId].add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palaver_path, out._palaver_rows = path, counted.get["n"]
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _WRITTEN[spark.sparkContext.applicationId].discard(path)


def forget(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote; only for frames no later plan reads."""
    for df in frames:
        if path := getattr(df, "_palaver_path", None):
            delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all that is left of ``materialise``'s files in this application.

    Operators return lazy frames that read such files, so the caller calls this, after the
    results are written.
    """
    for path in list(_WRITTEN[spark.sparkContext.applicationId]):
        delete(spark, path)


def row_hash(text: str | Column = "text") -> Column:
    """64-bit hash of the text; with doc_id it names a row when ids are null or repeated."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch; the session's byte bound holds besides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what Arrow's pool holds unused goes back at its end.

    Workers are used again by later tasks and stages, so what a pool keeps adds to their memory.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task
