"""Stream groups in list state: restarts with open groups, and timers that outlive them."""

import time

import pytest

from palaver.streaming import groups


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "key string, payload string").coalesce(1).write.mode("append").json(folder)


def started(spark, folder, checkpoint, out, n, timeout_ms):
    stream = spark.readStream.schema("key string, payload string").json(folder)
    grouped = groups.group_stream(stream, "key", n=n, timeout_ms=timeout_ms)
    return grouped.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").start()


def until(query, spark, out, ready, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        query.awaitTermination(1)
        try:
            got = spark.read.parquet(out).collect()
        except Exception:  # noqa: BLE001 - nothing is written yet
            got = []
        if ready(got):
            break
    return sorted((r.key, r.size, r.reason, sorted(r.members)) for r in got)


def test_open_groups_outlive_a_restart(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    feed(spark, folder, [("x", "a"), ("x", "b"), ("y", "1"), ("z", "r"), ("z", "s"), ("z", "t"), ("z", "u"), ("z", "v")])
    q = started(spark, folder, checkpoint, out, 4, 3_600_000)
    until(q, spark, out, lambda rows: len(rows) >= 1)  # timers keep the query busy, so it is polled
    q.stop()
    assert [(r.key, r.size) for r in spark.read.parquet(out).collect()] == [("z", 4)]
    feed(spark, folder, [("x", "c"), ("x", "d"), ("x", "e"), ("z", "w"), ("z", "x"), ("z", "y")])
    q = started(spark, folder, checkpoint, out, 4, 3_600_000)
    got = until(q, spark, out, lambda rows: len(rows) >= 3)
    q.stop()
    assert [g[:3] for g in got] == [("x", 4, "count"), ("z", 4, "count"), ("z", 4, "count")]
    held = [m for g in got for m in g[3]]
    assert len(held) == len(set(held)) and {"a", "b"} <= set(held) and {"r", "s", "t", "u", "v"} <= set(held)


def test_timers_go_on_after_a_restart(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    feed(spark, folder, [("x", "a"), ("y", "1")])
    q = started(spark, folder, checkpoint, out, 4, 20_000)
    end = time.time() + 120
    while not (tmp_path / "checkpoint" / "commits" / "0").exists() and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert (tmp_path / "checkpoint" / "commits" / "0").exists()  # the groups are open and their timers set
    feed(spark, folder, [("z", "new")])  # a restarted query makes no batch of its own before rows come
    q = started(spark, folder, checkpoint, out, 4, 20_000)
    got = until(q, spark, out, lambda rows: {"x", "y"} <= {r.key for r in rows})
    failed = q.exception()
    q.stop()
    assert failed is None and got[:2] == [("x", 1, "timeout", ["a"]), ("y", 1, "timeout", ["1"])]


def test_the_state_store_is_asked_for(spark):
    name, store = groups.STATE_STORE
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(RuntimeError, match="providerClass"):
            groups.group_stream(spark.range(1).selectExpr("'a' AS key", "'b' AS payload"), "key")
    finally:
        spark.conf.set(name, store)
