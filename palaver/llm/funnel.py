"""Ordered funnels over clients' rows, by bitmaps over distinct-time indexes.

Rows are first summed to one row per client and time, with a bit for each kind; equal rows
fall together there, before anything is dealt by client. Time is cut into segments of
``SEGMENT`` microseconds. A segment also holds a halo: the client's rows of the horizon after
its end, so each attempt is decided in the segment that it starts in, and a client with a
third of all rows is spread over all its segments.

A task reads its segments in order of time. The place of a distinct time is its index; each
kind is a bitmap over the indexes, 64 to a word. The next row of a kind is the lowest set bit
from an index on: of the masked word, or of the next word that is not zero. A step is reached
if that row is in the segment, within the horizon, and the next set bit of the excluded kind
lies behind it. A task holds ``CHUNK`` rows and those of one horizon, however long a segment.

Attempts leave a task as counts per (funnel, client, step, microseconds from the previous
step). Percentiles are radix-selected from those: a histogram of the highest ten bits, the
digit in which the rank falls, then the same among the times of that digit. No time list of
a client is sorted or gathered.

Defined results: rows with a null client, kind or time do not count; repeated rows count
once; other columns are not read. An empty table gives no row. Rows of one time are neither
before nor after each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from palaver.llm.common import materialise

SECOND = 1_000_000
#: Microseconds of a segment; a horizon may not be longer.
SEGMENT = 3600 * SECOND
#: Rows that a task looks at together.
CHUNK = 1 << 17
#: Bits of a radix digit.
DIGIT = 10


@dataclass(frozen=True)
class Funnel:
    """Kinds in order, the kind that ends an attempt, and the microseconds from the first step to the last."""

    name: str
    steps: tuple[str, ...]
    exclude: str
    horizon: int = 300 * SECOND


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)


def micros(time: Column, kind) -> Column:
    """Microseconds since 1970 of a time, whatever the session's zone where it has none of its own."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(time)
    seconds = F.unix_date(F.to_date(time)) * F.lit(86_400).cast("long") + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * SECOND + (F.date_part(F.lit("SECOND"), time) * SECOND).cast("long")


class Bitmap:
    """Set bits of one kind, with the next word that is not zero for each word."""

    def __init__(self, held: np.ndarray):
        packed = np.packbits(held, bitorder="little")
        self.words = np.zeros(len(held) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        number = np.where(self.words != 0, np.arange(len(self.words)), len(self.words))
        self.following = np.append(np.minimum.accumulate(number[::-1])[::-1], len(self.words))
        self.end = len(held)

    def next(self, at: np.ndarray) -> np.ndarray:
        """Least set bit from each of ``at`` (no more than the size) on; the size where there is none."""
        word = at >> 6
        rest = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        far = np.flatnonzero(rest == 0)
        word[far] = self.following[word[far] + 1]
        inside = word < len(self.words)
        got = np.full(len(at), self.end, np.int64)
        rest[far] = self.words[np.minimum(word[far], len(self.words) - 1)]
        low = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        got[inside] = (word[inside] << 6) + low[inside]
        return got


def reached(time: np.ndarray, last: np.ndarray, start: np.ndarray, bitmaps: dict[str, Bitmap], funnel: Funnel) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step: which of ``start`` reach it, and their microseconds from the previous step.

    ``last``: the last index of each index's segment.
    """
    alive, before = np.arange(len(start)), start
    out = [(alive, np.zeros(len(start), np.int64))]
    for kind in funnel.steps[1:]:
        on = bitmaps[kind].next(before + 1)
        barred = bitmaps[funnel.exclude].next(before + 1)
        fits = (on <= last[before]) & (barred > on)
        fits &= time[np.minimum(on, len(time) - 1)] - time[start[alive]] <= funnel.horizon
        took = time[on[fits]] - time[before[fits]]
        alive, before = alive[fits], on[fits]
        out.append((alive, took))
    return out


def _starts(column: pa.Array) -> np.ndarray:
    """Where the values of a sorted column change, 0 first."""
    if len(column) < 2:
        return np.arange(len(column))
    changed = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(changed) + 1)


def _counter(funnels: tuple[Funnel, ...], kinds: list[str], segment: int):
    longest = max(f.horizon for f in funnels)
    names = ["funnel", "client", "step", "took", "n"]

    def decided(rows: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Counts of the attempts whose horizon ``rows`` hold whole, and the rows to see again."""
        client = rows.column("client").combine_chunks()
        seg, time, marks = (rows.column(c).to_numpy() for c in ("segment", "time", "marks"))
        of_client = _starts(client)
        borders = np.union1d(of_client, np.flatnonzero(np.diff(seg)) + 1)
        ends = np.append(borders[1:], len(time)) - 1
        last = np.repeat(ends, np.diff(np.append(borders, len(time))))
        # what the last segment still lacks: it may go on in the next batch
        whole = len(time) if final else max(borders[-1], np.searchsorted(time[borders[-1] :], time[-1] - longest) + borders[-1])
        own = (time[:whole] // segment == seg[:whole]).nonzero()[0]
        bitmaps = {k: Bitmap((marks >> i & 1).astype(bool)) for i, k in enumerate(kinds)}
        out = []
        for f in funnels:
            start = own[(marks[own] >> kinds.index(f.steps[0]) & 1).astype(bool)]
            holder = np.searchsorted(of_client, start, "right") - 1
            for step, (alive, took) in enumerate(reached(time, last, start, bitmaps, f), 1):
                if len(alive):
                    pair = holder[alive] * (f.horizon + 1) + took
                    pair, n = np.unique(pair, return_counts=True)
                    at = pa.array(of_client[pair // (f.horizon + 1)])
                    cols = [pa.array([f.name] * len(n)), client.take(at), pa.array(np.full(len(n), step, np.int32)), pa.array(pair % (f.horizon + 1)), pa.array(n)]
                    out.append(pa.RecordBatch.from_arrays(cols, names=names))
        return out, rows.slice(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                found, rest = decided(pa.Table.from_batches(held), False)
                yield from found
                held, size = rest.to_batches(), 0  # a dense horizon is seen again with as many new rows
        if any(b.num_rows for b in held):
            yield from decided(pa.Table.from_batches(held), True)[0]

    return run


def attempt_times(rows: DataFrame, client: str, kind: str, time: str, funnels: tuple[Funnel, ...] = FUNNELS, segment: int = SEGMENT) -> DataFrame:
    """(funnel, client, step, took, n): attempts that reach the step so many microseconds after the previous one."""
    if any(not 0 <= f.horizon <= segment for f in funnels):
        raise ValueError("a horizon must not be longer than a segment")
    kinds = sorted({k for f in funnels for k in (*f.steps, f.exclude)})
    if len(kinds) > 62:
        raise ValueError("62 kinds at most")
    mark = F.element_at(F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(1 << i).cast("long"))]), F.col(kind))
    used = rows.where(F.col(kind).isin(kinds) & F.col(client).isNotNull() & F.col(time).isNotNull())
    used = used.select(F.col(client).alias("client"), micros(F.col(time), rows.schema[time].dataType).alias("time"), mark.alias("mark"))
    times = used.groupBy("client", "time").agg(F.bit_or("mark").alias("marks"))
    at = F.expr(f"(time - pmod(time, {segment})) div {segment}")
    in_halo = F.pmod("time", F.lit(segment)) < max(f.horizon for f in funnels)
    placed = times.select("client", F.explode(F.when(in_halo, F.array(at, at - 1)).otherwise(F.array(at))).alias("segment"), "time", "marks")
    placed = placed.repartition("client", "segment").sortWithinPartitions("client", "segment", "time")
    kind_of_client = rows.schema[client].dataType.simpleString()
    counted = placed.mapInArrow(_counter(funnels, kinds, segment), f"funnel string, client {kind_of_client}, step int, took long, n long")
    return counted.groupBy("funnel", "client", "step", "took").agg(F.sum("n").alias("n"))


def radix_percentile(times: DataFrame, keys: list[str], value: str, percent: int, bits: int) -> DataFrame:
    """keys and ``value``: the ceil(percent * n / 100)-th smallest value of each key.

    ``times``: keys, value (0 to 2**bits - 1), n (how often). A round keeps of each key one
    histogram of 1,024 digits at most.
    """
    rank = F.expr(f"({percent} * n + 99) div 100")
    state = times.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, F.lit(0).cast("long").alias("prefix"), rank.alias("rank"))
    shift = -(-bits // DIGIT) * DIGIT
    while shift > 0:
        above, shift = shift, shift - DIGIT
        placed = times.withColumn("prefix", F.shiftright(value, above)).withColumn("digit", F.shiftright(value, shift))
        hist = placed.groupBy(*keys, "prefix", "digit").agg(F.sum("n").alias("n"))
        held = hist.join(state, [*keys, "prefix"])
        up = Window.partitionBy(*keys).orderBy("digit")
        held = held.withColumn("below", F.sum("n").over(up) - F.col("n"))
        held = held.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        state = held.select(*keys, F.col("digit").alias("prefix"), (F.col("rank") - F.col("below")).alias("rank"))
    return state.select(*keys, F.col("prefix").alias(value))


def funnel_counts(
    rows: DataFrame, client: str = "client_id", kind: str = "kind", time: str = "arrived_at", funnels: tuple[Funnel, ...] = FUNNELS, percent: int = 25, segment: int = SEGMENT
) -> DataFrame:
    """funnel, client, n1.. (attempts that reach each step), deepest, t2.. and same_depth.

    One row for each funnel and client with an attempt. t2 and so on are percentiles of the
    microseconds from the previous step (null where no attempt reaches the step); same_depth
    counts the clients of equal funnel and deepest step.
    """
    found = materialise(attempt_times(rows, client, kind, time, funnels, segment), "funnel-times")
    most = max(len(f.steps) for f in funnels)
    bits = max(f.horizon for f in funnels).bit_length()
    keys = ["funnel", "client", "step"]
    took = radix_percentile(found.where("step > 1"), keys, "took", percent, bits)
    # counts and percentiles of a client meet in one sum, not in a join
    both = found.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("took", F.lit(None).cast("long"))
    both = both.unionByName(took.withColumn("n", F.lit(0).cast("long")))
    n = [F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, most + 1)]
    t = [F.max(F.when(F.col("step") == k, F.col("took"))).alias(f"t{k}") for k in range(2, most + 1)]
    out = both.groupBy("funnel", "client").agg(*n, F.max("step").alias("deepest"), *t)
    out = materialise(out, "funnel-clients")
    depth = out.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    # a row for each funnel and step at most
    return out.join(F.broadcast(depth), ["funnel", "deepest"]).select("funnel", "client", *[f"n{k}" for k in range(1, most + 1)], "deepest", *[f"t{k}" for k in range(2, most + 1)], "same_depth")
