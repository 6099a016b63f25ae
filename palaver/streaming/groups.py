"""Grouping of streamed rollouts by key, routing and append-only logs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

GROUP_SIZE, TIMEOUT_MS = 4, 180_000
KEY_FIELDS = ["index", "user_id", "raw_user_id", "post_id", "target_idx", "prompt_text", "context", "user_history", "ground_truth"]


def group_key(step: Column, fields: dict[str, Column]) -> Column:
    """``step:response:prompt_idx:<index>:hash:<sha1>``; without an index the hash alone."""
    text = lambda name: F.coalesce(fields[name].cast("string"), F.lit("")) if name in fields else F.lit("")
    digest = F.sha1(F.concat_ws("\n", *[text(n) for n in KEY_FIELDS]).cast("binary"))
    index = fields["index"].cast("string") if "index" in fields else F.lit(None).cast("string")
    named = F.concat(F.lit("prompt_idx:"), index, F.lit(":hash:"), digest)
    return F.concat(step.cast("string"), F.lit(":response:"), F.coalesce(named, F.concat(F.lit("prompt_hash:"), digest)))


def bucket(key: Column, workers: int) -> Column:
    """First 8 bytes of SHA-1, big-endian, modulo the number of workers."""
    digest = F.sha1(key.cast("binary"))
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return ((high % workers) * (2**32 % workers) + low % workers) % workers


def group_by_count(rows: DataFrame, key: str, order: list[str], n: int = GROUP_SIZE) -> DataFrame:
    """Batch form: ``group_no`` of every n successive rows of a key, and the group's size."""
    numbered = rows.withColumn("group_no", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / n).cast("long"))
    return numbered.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(key, "group_no")))


class _Grouper(StatefulProcessor):
    """Open groups: members in a list state, their number and deadline beside it.

    New members are appended and old ones stay where they are until the group is flushed, so an
    arrival costs what it brings, however large a group may grow.
    """

    def __init__(self, key: str, n: int, timeout_ms: int):
        self.key, self.n, self.timeout_ms = key, n, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getListState("members", "payload string")
        self.open = handle.getValueState("open", "size int, deadline bigint")

    def _flushed(self, key: tuple, reason: str, members: list[str]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "size": [len(members)], "reason": [reason], "members": [members]})

    def _held(self) -> list[str]:
        return [m[0] for m in self.members.get()] if self.members.exists() else []

    def _close(self, deadline: int | None) -> None:
        self.members.clear()
        self.open.clear()
        if deadline is not None:
            self.handle.deleteTimer(deadline)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        size, deadline = self.open.get() if self.open.exists() else (0, None)
        if size and deadline <= now:  # overdue when new rows come
            yield self._flushed(key, "timeout", self._held())
            self._close(deadline)
            size, deadline = 0, None
        for batch in rows:
            new = batch["payload"].tolist()
            while new:
                part, new = new[: self.n - size], new[self.n - size :]
                if size + len(part) == self.n:
                    yield self._flushed(key, "count", (self._held() if size else []) + part)
                    if size:
                        self._close(deadline)
                    size, deadline = 0, None
                    continue
                self.members.appendList([(p,) for p in part])
                size += len(part)
                if deadline is None:
                    deadline = now + self.timeout_ms
                    self.handle.registerTimer(deadline)
        if size:
            self.open.update((size, deadline))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        size, deadline = self.open.get() if self.open.exists() else (0, None)
        # a timer may be older than the group that is open now
        if size and deadline <= timerValues.getCurrentProcessingTimeInMs():
            yield self._flushed(key, "timeout", self._held())
            self._close(None)

    def close(self) -> None:
        pass


#: The state store that list states and timers need; set it before a query is started.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def group_stream(rows: DataFrame, key: str, n: int = GROUP_SIZE, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Streaming form: (key, size, reason, members) whenever n rows of a key are there or time is up.

    ``rows``: key and ``payload`` (string). The time runs from the first arrival of a group, so
    a trickle of rows does not put it off. Rows that come after a flush open a new group.
    With n = 8 and 5 ms it batches requests by size or time. The session needs ``STATE_STORE``; open groups
    and their timers live in the checkpoint. After a restart Spark makes no batch before rows of any key
    come, so an overdue group is flushed with the first rows that follow.
    """
    name, store = STATE_STORE
    if rows.sparkSession.conf.get(name, "") != store:
        raise RuntimeError(f"set {name} to {store}")
    schema = f"{key} string, size int, reason string, members array<string>"
    grouper = _Grouper(key, n, timeout_ms)
    return rows.groupBy(key).transformWithStateInPandas(grouper, schema, "Append", "ProcessingTime")


def score_batches(rows: DataFrame, prompt: str, hook, size: int = 8) -> DataFrame:
    """``rows`` with ``score`` and ``error``: the hook gets up to ``size`` prompts at a time.

    ``hook(list of prompts) -> list of numbers``. A wrong number of results, or an exception,
    is the error of every row of that batch and of no other.
    """
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, errors = [], []
            for at in range(0, len(batch), size):
                part = batch[prompt].iloc[at : at + size].tolist()
                try:
                    got, error = [float(x) for x in hook(part)], None
                    if len(got) != len(part):
                        raise RuntimeError(f"{len(got)} results for {len(part)} prompts")
                except Exception as problem:  # noqa: BLE001 - any failure belongs to this batch
                    got, error = [None] * len(part), f"{type(problem).__name__}: {problem}"
                scores += got
                errors += [error] * len(part)
            yield batch.assign(score=pd.Series(scores, index=batch.index, dtype="float64"), error=pd.Series(errors, index=batch.index, dtype="object"))

    return rows.mapInPandas(run, schema)


def pooled(call, limit: int = 400, retries: int = 3, wait: float = 0.0):
    """A hook for ``complete`` from a function of one prompt: up to ``limit`` calls at a time in a task,
    each tried again up to ``retries`` times; a prompt that still fails gets None. The limit of a
    job is this times the tasks that run at once."""

    def tried(prompt: str) -> str | None:
        for i in range(retries + 1):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001 - the transport's errors are not known here
                if i < retries:
                    time.sleep(wait * 2**i)
        return None

    def hook(prompts: pd.Series) -> pd.Series:
        with ThreadPoolExecutor(max_workers=max(1, min(limit, len(prompts)))) as pool:
            return pd.Series(list(pool.map(tried, prompts)), index=prompts.index, dtype="object")

    return hook


def append_log(stream: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """An append-only JSON log of a stream, a micro-batch at a time."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(processingTime=every).start(path)


def complete(rows: DataFrame, prompt: str, hook, schema: StructType | str) -> DataFrame:
    """Model text by a hook over batches: ``hook(pandas.Series of prompts) -> Series``, in column ``completion``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(completion=hook(batch[prompt]))

    return rows.mapInPandas(run, schema)


def complete_limited(rows: DataFrame, prompt: str, call, limit: int = 400, pool: int = 25, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """``rows`` with ``completion``, with no more than ``limit`` calls in flight in the whole job.

    The rows are dealt into limit // pool partitions, so that no more tasks can run at a time, on however
    large a cluster, and each has up to ``pool`` calls in flight. A task that is run again after its
    executor was lost repeats its calls; with speculation, copies of tasks come on top.
    """
    if limit < 1 or pool < 1:
        raise ValueError("limit and pool must be positive")
    pool = min(pool, limit)
    schema = StructType([*rows.schema.fields, StructField("completion", StringType())])
    return complete(rows.repartition(limit // pool), prompt, pooled(call, pool, retries, wait), schema)


def retry_rounds(wanted: DataFrame, key: str, attempt, rounds: int, shared) -> DataFrame:
    """Up to ``rounds`` attempts over the keys that still have no answer.

    ``attempt(missing, round)`` gives (key, answer) for some of them; ``shared(df)`` writes
    and rereads what a round gave, so later rounds don't repeat it.
    """
    found = None
    missing = wanted
    for i in range(rounds):
        got = shared(attempt(missing, i).where(F.col("answer").isNotNull()).withColumn("round", F.lit(i)))
        found = got if found is None else found.unionByName(got)
        missing = wanted.join(found.select(key), key, "left_anti")
        if missing.isEmpty():
            break
    return found


def accept(attempts: DataFrame, key: str) -> DataFrame:
    """Of numbered attempts (parsed, leaks, answer): the first clean one, else the last that parsed."""
    parsed = attempts.where("parsed")
    clean = F.min_by(F.when(~F.col("leaks"), F.col("answer")), F.when(~F.col("leaks"), F.col("attempt")))
    out = parsed.groupBy(key).agg(clean.alias("_c"), F.max_by("answer", "attempt").alias("_l"))
    return out.select(key, F.coalesce("_c", "_l").alias("answer"), F.col("_c").isNull().alias("leaks"))


def batch_metrics(rows: DataFrame, columns: list[str], active: str) -> DataFrame:
    """Mean of every numeric column, over all rows and where ``active`` > 0; empty ones drop out."""
    doubles = [F.col(c).try_cast("double").alias(c) if rows.schema[c].dataType.simpleString() == "string" else F.col(c).cast("double").alias(c) for c in columns]
    long = rows.select(F.col(active).alias("_a"), *doubles).unpivot(["_a"], columns, "metric", "value")
    got = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.avg(F.when(F.col("_a") > 0, F.col("value"))).alias("active_mean"))
    return got.where("mean is not null")
