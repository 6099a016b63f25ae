"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The temporary folder of each local application without a ``spark.checkpoint.dir``.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a cluster session without one raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="palaver-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, counting: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` as a Parquet table, and its number of rows (where ``counting`` holds; no fewer, where tasks were run again)."""
    spark, counted = df.sparkSession, Observation()
    path = scratch(spark, label)
    df.observe(counted, F.count_if(F.lit(True) if counting is None else counting).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), counted.get["n"]
