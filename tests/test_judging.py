"""The judging path, settings and streamed groups, against small written cases."""

import dataclasses
import time

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palaver import settings
from palaver.functions import scoring
from palaver.operators import judging, splits
from palaver.sources.tables import read_targets
from palaver.streaming import groups


def targets(spark, rows):
    return spark.createDataFrame(
        rows, "user_id string, target_no long, post_id string, target_idx long, ground_truth string, context string, user_history string, generations array<string>, generated_response string"
    )


def test_jobs_and_reassembly(spark):
    t = targets(
        spark,
        [
            ("u", 0, "p", 1, "t", "c", "", ["a", "b"], None),
            ("u", 1, "p", 2, "t", "c", "old", [], "one"),
            ("u", 2, "p", 3, "t", "c", "", None, ""),
        ],
    )
    found = judging.jobs(judging.with_history(t)).orderBy("target_no", "gen_no").collect()
    assert [(r.target_no, r.gen_no, r.response, r.user_history) for r in found] == [(0, 0, "a", "old"), (0, 1, "b", "old"), (1, 0, "one", "old")]
    answers = lambda jobs: jobs.where("response = 'b'").select(*judging.JOB, F.lit('{"score": 0.5, "thought": "t"}').alias("raw"))
    got = {r.target_no: r for r in judging.judge(t, "similarity", answers).collect()}
    assert got[0].generations == ["a", "b"] and got[0].score == [0.0, 0.5] and got[0].parse_error == [True, False]
    assert got[1].score == [0.0] and 2 not in got


def test_pairwise_needs_a_history(spark):
    t = targets(spark, [("u", 0, "p", 1, "t", "c", "", ["a"], None)])
    with pytest.raises(PySparkException, match="needs a history"):
        judging.judge(t, "pairwise", lambda jobs: jobs.select(*judging.JOB, F.lit("").alias("raw"))).collect()


def test_groups_must_agree(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, "")], "key long, context string")
    assert judging.consistent_groups(rows, "key", ["context"]).count() == 4
    with pytest.raises(PySparkException, match="differ"):
        judging.consistent_groups(rows.union(spark.createDataFrame([(1, "b")], rows.schema)), "key", ["context"]).collect()


def test_ratings_of_strings(spark):
    cases = {'{"rating": 6.7}': 6, '{"rating": "6.7"}': None, '{"rating": " 6 "}': 6, '{"rating": 9}': None, '{"rating": true}': 1, '{"rating": [3]}': None, '{"rating": "7x"}': None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.rating for r in rows.select("raw", scoring.pairwise("raw")["rating"].alias("rating")).collect()}
    assert got == cases


def test_result_names():
    assert judging.result_name("x/run1_gen3_gen_final.pkl", "pairwise", "out") == "out/run1_gen3_turing"
    assert judging.result_name("plain.parquet", "similarity", "out") == "out/plain_sim"
    assert judging.reward("logprob") is scoring.logprob_reward
    with pytest.raises(KeyError):
        judging.reward("none")
    with pytest.raises(ValueError):
        judging.register("logprob")(scoring.logprob_reward)


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport A='x y' # why\nB=\nC=old\n")
    environ = {"C": "new"}
    settings.load_env([tmp_path / "none", tmp_path / ".env"], environ)
    assert environ == {"A": "x y", "B": "", "C": "new"}

    @dataclasses.dataclass
    class Options:
        rounds: int = 1
        strict: bool = False

    assert settings.options(Options, {"rounds": "3"}, {"strict": "Yes", "rounds": None}) == Options(3, True)
    with pytest.raises(ValueError):
        settings.options(Options, {"round": 1})
    assert settings.flag(None, True) and not settings.flag("off", True)


def test_score_batches(spark):
    def hook(prompts):
        if "bad" in prompts:
            raise KeyError("no")
        return [len(p) for p in prompts][: 1 if "short" in prompts else None]

    rows = spark.createDataFrame([("a",), ("bb",), ("bad",), ("x",), ("short",), ("y",)], "prompt string").coalesce(1)
    got = [(r.prompt, r.score, r.error) for r in groups.score_batches(rows, "prompt", hook, 2).collect()]
    assert got[:2] == [("a", 1.0, None), ("bb", 2.0, None)]
    assert all(s is None and "KeyError" in e for _, s, e in got[2:4]) and all("1 results for 2" in e for _, _, e in got[4:])


def test_pooled_hook_tries_again():
    tries = {}

    def call(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt == "never" or tries[prompt] < 3:
            raise OSError
        return prompt.upper()

    got = groups.pooled(call, limit=2, retries=3)(pd.Series(["a", "never"]))
    assert got.tolist() == ["A", None] and tries == {"a": 3, "never": 4}


def test_a_trickle_does_not_put_off_the_timeout(spark, tmp_path):
    """Rows keep coming for one key, more often than the time-out, and the first group is still flushed on time."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("key string, payload string").json(str(folder))
    query = (
        groups.group_stream(stream, "key", n=1000, timeout_ms=3000)
        .writeStream.format("memory").queryName("trickle").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        end = time.time() + 60
        i = 0
        while time.time() < end and not spark.table("trickle").count():
            (folder / f"{i}.json").write_text('{"key": "k", "payload": "%d"}' % i)
            i += 1
            time.sleep(0.5)
        got = spark.table("trickle").collect()
        assert got and got[0].reason == "timeout" and 0 < got[0].size < i + 1
    finally:
        query.stop()


def test_global_numbers_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_ROWS", 20)
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)]
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.name: r.at for r in splits.globally_numbered(rows, "at", ["name"]).collect()}
    assert got == {n: i for i, n in enumerate([None, *sorted(names)])}
    ids = splits.sequential_ids(rows, "name", "x", 2)
    assert {r.anonymous_id for r in ids.collect()} == {f"x_{i:02d}" for i in range(1000)}
    users = rows.where("name is not null").withColumn("split", F.lit("a"))
    numbered = splits.number_rows(users, "name", "split", ["name"])
    assert [r.prompt_idx for r in numbered.orderBy("name").collect()] == list(range(1000))


def test_target_checks(spark):
    rows = spark.createDataFrame([(i, u, "history", None) for i, u in enumerate("bbaac")], "at long, user_id string, conditioning_mode string, prompt_mode string")
    got = read_targets(rows, "at", "user_id", offset=1, user_offset=1, users=1, modes={"conditioning_mode": "history", "prompt_mode": "x"})
    assert sorted((r["at"], r.user_id, r.user_ord) for r in got.collect()) == [(2, "a", 2), (3, "a", 2)]
    with pytest.raises(ValueError):
        read_targets(rows, "at", "user_id", offset=5)
    with pytest.raises(ValueError):
        read_targets(rows, "at", "user_id", user_offset=3)
    with pytest.raises(PySparkException, match="conditioning_mode"):
        read_targets(rows, "at", "user_id", modes={"conditioning_mode": "persona"}).collect()
