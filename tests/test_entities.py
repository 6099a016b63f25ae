"""Character references in the JVM against ``html.unescape``."""

import html
import html.entities
import random

from pyspark.sql import functions as F

from palaver.functions import entities, text


def both(spark, texts, times=1):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", entities.decoded(F.col("t"), times).alias("x")).collect()}
    want = list(texts)
    for _ in range(times):
        want = [html.unescape(t) for t in want]
    return [(t, got[i], w) for i, (t, w) in enumerate(zip(texts, want)) if got[i] != w]


def test_every_name(spark):
    names = sorted(html.entities.html5)
    texts = [f"a &{n} b" for n in names] + [f"&{n}x;" for n in names if not n.endswith(";")] + [f"&{n[:-1]}" for n in names if n.endswith(";")]
    assert both(spark, texts) == []


def test_numbers(spark):
    special = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFE, 0x10FFFF, 0x110000, 10**9, 2**70]
    texts = [f"<&#{n};>" for n in special] + [f"&#x{n:x}" for n in special] + [f"&#X{n:06X};z" for n in special] + ["&#0000065;", "&#x000000041", "&#;", "&#x;", "&#xg", "&# 1;", "&#1a;"]
    assert both(spark, texts) == []


def test_random_texts(spark):
    rng = random.Random(4)
    bits = ["&", "amp;", "amp", "lt", "gt;", "#", "x", "38", ";", " ", "é", "😀", "notit;", "not", "copy", "&amp;", "&lt", "\n", "<", "y" * 40, "\\"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(1500)] + ["&" * 30_000 + "amp;" * 3, "plain", ""]
    assert both(spark, texts) == []
    assert both(spark, texts, 3) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(None,), ("&amp;amp;lt;",), (r"\&gt;",)], "t string")
    got = df.select(text.unescape_entities("t").alias("x"))
    assert [r.x for r in got.collect()] == ["", "<", ">"]
    assert "Python" not in got._jdf.queryExecution().toString()
