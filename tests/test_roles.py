"""Users by role: held out first, then an offset and a cap on the rest."""

import pytest
from pyspark.sql import functions as F

from palaver.operators import splits


def test_offset_and_cap(spark):
    rows = spark.range(60).select((F.col("id") % 12).alias("user"), F.col("id").alias("thread")).union(spark.createDataFrame([(99, 1), (99, 1), (98, None)], "user long, thread long"))
    whole = splits.user_roles(rows, "user", "thread", least=5, heldout=0.3)
    by = {r.user: (r.user_rank, r.role) for r in whole.collect()}
    assert sorted(rank for rank, _ in by.values()) == list(range(1, 13)) and sum(role == "heldout" for _, role in by.values()) == 3
    assert all((rank <= 3) == (role == "heldout") for rank, role in by.values())
    some = {r.user: r.user_rank for r in splits.user_roles(rows, "user", "thread", least=5, heldout=0.3, offset=2, most_users=4).where("role = 'train'").collect()}
    assert sorted(some.values()) == [6, 7, 8, 9] and all(by[u][0] == rank for u, rank in some.items())
    assert splits.user_roles(rows, "user", "thread", least=5, heldout=0.3, offset=50).where("role = 'train'").count() == 0
    assert splits.user_roles(rows.where("false"), "user", "thread", least=1, heldout=0.5).count() == 0


def test_conversations_of_each_role(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(10)] + [("c", 1), ("d", 1), ("d", 2)], "user string, thread int")
    roles = spark.createDataFrame([("a", "train"), ("b", "heldout"), ("c", "heldout"), ("d", "heldout")], "user string, role string")
    got = {}
    for r in splits.role_conversations(rows.union(rows), "user", "thread", roles, share=0.3, low=2, high=4).collect():
        got.setdefault(r.user, {})[r.place] = r.split
    assert sorted(got["a"]) == list(range(1, 11)) and set(got["a"].values()) == {"history", "train"}
    history = list(got["b"].values()).count("history")
    assert 2 <= history <= 4 and list(got["b"].values()).count("val") == max(1, int(0.3 * (10 - history)))
    assert [got["b"][i] for i in range(1, history + 1)] == ["history"] * history
    # one thread is history, of two one is left to be val
    assert got["c"] == {1: "history"} and got["d"] == {1: "history", 2: "val"}


@pytest.mark.parametrize("wrong", [{"least": 0}, {"heldout": 1.0}, {"heldout": -0.1}, {"offset": -1}, {"most_users": 0}])
def test_ranges_of_roles(spark, wrong):
    rows = spark.createDataFrame([("a", 1)], "user string, thread int")
    with pytest.raises(ValueError):
        splits.user_roles(rows, "user", "thread", **({"least": 1, "heldout": 0.5} | wrong))


@pytest.mark.parametrize("wrong", [{"share": 1.0}, {"share": -1}, {"share": 0.5, "low": 0}, {"share": 0.5, "low": 3, "high": 2}])
def test_ranges_of_conversations(spark, wrong):
    rows = spark.createDataFrame([("a", 1)], "user string, thread int")
    with pytest.raises(ValueError):
        splits.role_conversations(rows, "user", "thread", rows.selectExpr("user", "'train' AS role"), **wrong)
