"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from palaver.functions import scoring
from palaver.plans import catalogue, evaluation  # noqa: F401 - adds its queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    assert len(got) > 0 or name.startswith(("copy", "leak"))
    if name in catalogue.ORACLE:
        want = con.execute(catalogue.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_redacts_behind_the_first_characters(spark, tmp_path):
    late = "plain words " * 20 + "by /u/some_name and https://redd.it/zz9"
    texts = [late, late.replace("some_name", "other_name").replace("zz9", "yy8")]
    for i, t in enumerate(texts):
        spark.createDataFrame([(7, t)], "doc_id long, text string").write.parquet(f"{tmp_path}/{i}/documents.parquet")
    a, b = (catalogue.QUERIES["redact_identifiers"](spark, f"{tmp_path}/{i}").first().redacted_sha for i in (0, 1))
    assert a == b


def _same_as_sql(spark, folder, name, tables):
    c = duckdb.connect()
    for table, (found, schema) in tables.items():
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder)).toPandas()
    assert rows(got) == rows(c.execute(catalogue.ORACLE[name]).df())
    return got


def test_length_penalty_rounds_as_sql_where_six_decimals_tie(spark, tmp_path):
    human = [40, 56, 64, 88, 104]
    docs = [(i, "w " * (i // 35)) for i in range(35, 35 * 110)]
    got = _same_as_sql(spark, tmp_path, "length_penalty", {
        "documents": (docs, "doc_id long, text string"), "benchmark": ([(i, "w " * n) for i, n in enumerate(human)], "item_id long, text string"),
    })
    # 41 words to 56 and a rating of 4: 0.5203125, in binary a little less
    assert got.set_index("doc_id").reward[35 * 41 + 31] == 0.520312


def test_means_round_as_sql_where_six_decimals_tie(spark, tmp_path):
    # 41 and 323 of 640 are 0.0640625 and 0.5046875, in binary a little less
    labels = [(i, int(i < 41), int(i < 323)) for i in range(640)]
    got = _same_as_sql(spark, tmp_path, "batch_metrics", {"labels": (labels, "doc_id long, quality int, toxic int")})
    assert dict(zip(got.metric, got["mean"])) == {"quality": 0.064062, "toxic": 0.504687}


def test_rounded_keeps_what_is_no_decimal(spark):
    values = [None, float("nan"), float("inf"), -1e305, -0.0000005, 0.5203125, 2.0000004]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", scoring.rounded(F.col("x")).alias("y"))
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, (r.y for r in got.orderBy("i").collect()))) == list(map(repr, want))
