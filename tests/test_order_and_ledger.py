"""Row order from files, ledgers of answers, and limits on calls in flight."""

import json
import time

import pytest
from pyspark.sql import functions as F

from palaver.sources import ordered
from palaver.streaming import groups, ledger


def test_files_come_back_in_row_order(spark, tmp_path):
    paths, want = [], []
    for n in (2, 0, 1):  # by place in the list, not by name
        path = str(tmp_path / f"f{n}")
        spark.range(n * 10_000, n * 10_000 + 3000, 1, 200).withColumn("text", F.lit("x")).write.parquet(path)
        paths.append(path)
        want += list(range(n * 10_000, n * 10_000 + 3000))
    for schema in (None, "id long"):
        got = ordered.read_ordered(spark, paths, schema).repartition(7)
        assert [r.id for r in sorted(got.collect(), key=lambda r: r.row_ord)] == want
        assert sorted(r.row_ord for r in got.collect()) == list(range(9000))
        assert {r.file_ord for r in got.where("id < 10000").collect()} == {1}
    assert sorted(r.id for r in ordered.first_rows(got, 3001).collect()) == [0, *range(20_000, 23_000)]
    counts = ordered.footer_counts(spark, paths)
    assert counts.agg(F.sum("rows")).first()[0] == 9000
    assert "ReadSchema: struct<>" in counts._jdf.queryExecution().toString()
    assert "struct<id" not in counts._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError, match="none"):
        ordered.checked_paths(spark, [*paths, str(tmp_path / "none")])


def test_union_in_order(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y")], "id int, t string")
    b = spark.createDataFrame([(2,), (0,)], "id int")
    got = ordered.ordered_union({"train": a, "val": b}, ["id"]).collect()
    assert sorted((r.row_ord, r.split, r.id, r.t) for r in got) == [(0, "train", 1, "y"), (1, "train", 3, "x"), (2, "val", 0, None), (3, "val", 2, None)]


def recorded(folder, fails=()):
    """An attempt that leaves a file for each call."""
    folder.mkdir(exist_ok=True)
    place = str(folder)

    def attempt(missing, round_):
        def answer(batches):
            import os
            import uuid

            for batch in batches:
                for k in batch["k"]:
                    open(os.path.join(place, f"{k}-{round_}-{uuid.uuid4().hex}"), "w").close()
                batch = batch.assign(answer=[None if (k + round_) % 3 == 0 else f"a{k}" for k in batch["k"]])
                yield batch[["k", "answer"]]

        if round_ in fails:
            raise KeyboardInterrupt
        return missing.mapInPandas(answer, "k long, answer string")

    return attempt


def calls(folder):
    out = {}
    for f in folder.iterdir():
        k = int(f.name.split("-")[0])
        out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("slices", [1, 3])
def test_a_killed_run_goes_on(spark, tmp_path, slices):
    wanted = spark.range(30).withColumnRenamed("id", "k")
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", "k", "long")
    with pytest.raises(KeyboardInterrupt):
        book.run(wanted, recorded(tmp_path / "calls", fails=(1,)), slices=slices)
    before = calls(tmp_path / "calls")
    assert before == {k: 1 for k in range(30)}
    answered = {k for k in range(30) if k % 3}
    assert {r.k for r in book.answers().collect()} == answered
    # a slice without its mark was never finished
    spark.createDataFrame([(0, "half", 0)], "k long, answer string, round int").write.parquet(f"{tmp_path}/book/slice-000900-x")
    (tmp_path / "book" / "slice-000900-x" / "_SUCCESS").unlink()
    got = ledger.Ledger(spark, f"file://{tmp_path}/book", "k", "long").run(wanted, recorded(tmp_path / "calls"), slices=slices, model="m")
    assert {r.k: r.answer for r in got.collect()} == {k: f"a{k}" for k in range(30)}
    assert {k: n for k, n in calls(tmp_path / "calls").items() if k in answered} == {k: 1 for k in answered}
    said = json.loads((tmp_path / "book" / "metadata.json").read_text())
    assert (said["total"], said["failed"], said["parameters"]) == (30, 0, {"model": "m"})


def test_incomplete_runs(spark, tmp_path):
    wanted = spark.range(9).withColumnRenamed("id", "k")
    never = lambda missing, _: missing.select("k", F.when(F.col("k") > 1, F.lit("x")).alias("answer"))
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", "k", "long")
    with pytest.raises(ledger.Incomplete, match="2 of 9 keys"):
        book.run(wanted, never, 2)
    assert book.answers().count() == 7
    got = book.run(wanted, never, 1, require_complete=False)
    assert got.count() == 7 and json.loads((tmp_path / "book" / "metadata.json").read_text())["examples"] == ["0", "1"]
    assert ledger.Ledger(spark, f"file://{tmp_path}/none", "k", "long").answers().count() == 0


@pytest.mark.parametrize("limit, pool", [(6, 2), (5, 2), (1, 9)])
def test_calls_in_flight_of_the_whole_job(spark, tmp_path, limit, pool):
    place = str(tmp_path)

    def call(prompt):
        start = time.time()
        time.sleep(0.05)
        with open(f"{place}/{prompt}", "w") as f:
            f.write(f"{start} {time.time()}")
        return prompt.upper()

    rows = spark.createDataFrame([(f"p{i}",) for i in range(40)], "p string").repartition(8)
    got = groups.complete_limited(rows, "p", call, limit, pool).collect()
    assert sorted(r.completion for r in got) == sorted(f"P{i}" for i in range(40))
    spans = [tuple(map(float, f.read_text().split())) for f in tmp_path.iterdir()]
    most = max(sum(a <= start < b for a, b in spans) for start, _ in spans)
    assert most <= limit
