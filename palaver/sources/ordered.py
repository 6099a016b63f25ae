"""Rows in the order of their files, and unions of frames in order.

The place of a row is that of its file (by place in the given paths, then by name within a folder) and its
index in the file, which Spark's Parquet reader gives. Counts come from the files' footers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.operators.splits import globally_numbered

#: Most files whose first places are broadcast (a path and three numbers: under 300 bytes each).
BROADCAST_FILES = 100_000


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def footer_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, file, rows) of every Parquet file that has rows; no column is read."""
    if not paths:
        raise ValueError("no path is given")
    each = [spark.read.parquet(p).select(F.lit(i).alias("file_ord"), F.col("_metadata.file_path").alias("file")) for i, p in enumerate(paths)]
    return _union(each).groupBy("file_ord", "file").agg(F.count(F.lit(1)).alias("rows"))


def file_starts(counts: DataFrame) -> DataFrame:
    """(file_ord, file, start): the place of each file's first row. A folder's files are numbered together, not all files."""
    inside = Window.partitionBy("file_ord").orderBy("file")
    placed = counts.withColumn("_before", F.sum("rows").over(inside) - F.col("rows"))
    totals = counts.groupBy("file_ord").agg(F.sum("rows").alias("_total"))  # a row for each given path
    ahead = totals.withColumn("_ahead", F.sum("_total").over(Window.orderBy("file_ord")) - F.col("_total"))
    return placed.join(F.broadcast(ahead), "file_ord").select("file_ord", "file", (F.col("_before") + F.col("_ahead")).alias("start"))


def read_ordered(spark: SparkSession, paths: list[str], schema: str | None = None, place: str = "row_ord") -> DataFrame:
    """The rows of several Parquet files or folders with ``file_ord`` (place in ``paths``) and ``place``.

    ``place`` is the row's place in the union of all files, from 0, however many tasks read them.
    ``schema`` (of the columns asked for) prunes and casts as Spark's reader does. An unknown path is an error.
    """
    starts = file_starts(footer_counts(spark, paths)).select(F.col("file_ord").alias("_o"), F.col("file").alias("_file"), "start")
    reader = spark.read if schema is None else spark.read.schema(schema)
    each = []
    for i, path in enumerate(paths):
        rows = reader.parquet(path)
        each.append(rows.select("*", F.lit(i).alias("file_ord"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")))
    rows = _union(each)
    files = starts.count()
    starts = F.broadcast(starts) if files <= BROADCAST_FILES else starts
    got = rows.join(starts, (F.col("file_ord") == F.col("_o")) & (F.col("_path") == F.col("_file")))
    return got.withColumn(place, F.col("start") + F.col("_row")).drop("_o", "_file", "_path", "_row", "start")


def ordered_union(frames: dict[str, DataFrame], order: list[str], label: str = "split", place: str = "row_ord") -> DataFrame:
    """All rows of the frames, first to last, with the frame's name and the row's place from 0.

    Inside a frame rows come in the order of the columns ``order``. Columns that a frame lacks are null.
    """
    if not frames:
        raise ValueError("no frame is given")
    named = [f.withColumn(label, F.lit(name)).withColumn("_frame", F.lit(i)) for i, (name, f) in enumerate(frames.items())]
    out = named[0]
    for frame in named[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    parts = [globally_numbered(out.where(F.col("_frame") == i), "_at", order) for i in range(len(named))]
    sizes = out.groupBy("_frame").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_frame", (F.sum("_n").over(Window.orderBy("_frame")) - F.col("_n")).alias("_ahead"))  # a row for each frame
    return _union(parts).join(F.broadcast(ahead), "_frame").withColumn(place, F.col("_at") + F.col("_ahead")).drop("_at", "_ahead", "_frame")


def first_rows(rows: DataFrame, n: int, place: str = "row_ord") -> DataFrame:
    """The first n rows of ``read_ordered`` or ``ordered_union``, by place and not by a sort."""
    return rows.where(F.col(place) < n)


def checked_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """``paths``, all of which must be there: up to 20 that are not are named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    missing = [p for p in paths if not there(p)]
    if missing:
        raise FileNotFoundError(f"{len(missing)} paths are missing: {', '.join(missing[:20])}")
    return paths

