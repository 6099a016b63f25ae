"""A durable, append-only ledger of answers, for calls that are dear and may fail.

Each slice of a round is a Parquet folder of its own below the ledger's path, and counts once Spark's
committer has marked it as whole. What is answered is anti-joined away before each
slice and at each rerun, so a run that was killed goes on where it was, and repeats no answered call.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Attempt = Callable[[DataFrame, int], DataFrame]


class Incomplete(RuntimeError):
    """Keys without an answer are left after the last round; what was answered is in the ledger."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str = "string", answer_type: str = "string"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"`{key}` {key_type}, answer {answer_type}, round int"

    def _folders(self) -> list[str]:
        """Folders of whole slices, in the order of writing."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        under = [s.getPath() for s in system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("slice-")]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(str(p) for p in under if system.exists(done(p, "_SUCCESS")))

    def answers(self) -> DataFrame:
        """(key, answer, round): of each key the answer of the earliest round."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        first = F.min_by(F.struct("answer", "round"), "round").alias("_a")
        return rows.groupBy(self.key).agg(first).select(self.key, "_a.answer", "_a.round")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` without an answer."""
        return wanted.join(self.answers().select(self.key), self.key, "left_anti")

    def add(self, got: DataFrame, round_: int) -> None:
        """Write the rows of ``got`` (key, answer) that have an answer, as one slice."""
        number = len(self._folders())
        rows = got.where(F.col("answer").isNotNull()).select(self.key, "answer", F.lit(round_).alias("round"))
        rows.write.parquet(f"{self.path}/slice-{number:06d}-{uuid.uuid4().hex}")

    def run(self, wanted: DataFrame, attempt: Attempt, rounds: int = 5, *, slices: int = 1, require_complete: bool = True, **parameters) -> DataFrame:
        """Answers of all ``wanted`` keys, by up to ``rounds`` rounds of ``attempt(missing, round)``.

        A round is done in ``slices`` parts by the hash of the key: a kill costs one part. ``attempt`` gives
        (key, answer) for some of its rows and is called on the missing ones only. ``metadata.json``
        beside the slices tells rounds, counts and ``parameters``. If keys are left, that
        is an ``Incomplete`` error after all is written, unless ``require_complete`` is false.
        """
        keys = wanted.select(self.key).distinct()
        left, used = self.missing(keys).count(), 0
        while left and used < max(1, rounds):
            for part in range(slices):
                todo = self.missing(wanted)
                if slices > 1:
                    todo = todo.where(F.pmod(F.xxhash64(self.key), F.lit(slices)) == part)
                self.add(attempt(todo, used), used)
            used += 1
            left = self.missing(keys).count()
        total = keys.count()
        some = [r[0] for r in self.missing(keys).orderBy(self.key).limit(5).collect()]
        said = {"total": total, "answered": total - left, "failed": left, "examples": [str(x) for x in some], "rounds": used, "max_rounds": rounds, "parameters": parameters}
        self._write("metadata.json", json.dumps(said, ensure_ascii=False, indent=2, sort_keys=True))
        if left and require_complete:
            raise Incomplete(f"{left} of {total} keys have no answer after {used} rounds (such as {some}); the others are in {self.path}, a rerun goes on from there")
        return wanted.join(self.answers(), self.key)

    def _write(self, name: str, text: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
