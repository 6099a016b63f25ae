"""Periodic runs and ordered funnels against brute force."""

import datetime as dt
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import entry, funnel, tandem

SF = "/root/testdata/sf0.001"


def brute_runs(w, words=6, exponent=4):
    out, seen = [], set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(words, exponent * q) and (i, n) not in seen:
                seen.add((i, n))
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kind, n = rng.randrange(6), rng.randrange(80)
    if kind < 2:
        return [rng.choice("ab" if kind else "abc") for _ in range(n)]
    if kind == 2:  # a Fibonacci word
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(8)):
            a, b = b, b + a
        return b
    if kind == 3:
        out = []
        while len(out) < n:
            out += [rng.choice("abcd") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
        return out
    if kind == 4:
        return ["a"] * n
    base = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 15))]
    return [rng.choice("abc") for _ in range(rng.randrange(9))] + base * rng.randrange(1, 8) + base[: rng.randrange(len(base))]


@pytest.mark.parametrize("words, exponent", [(6, 4), (2, 2), (3, 2), (4, 3)])
def test_runs_of_repetitive_texts(words, exponent):
    rng = random.Random(words * 10 + exponent)
    for _ in range(60):
        texts = [[c.encode() for c in repetitive(rng)] for _ in range(rng.randrange(1, 12))]
        assert tandem.find_runs(texts, words, exponent) == [brute_runs(t, words, exponent) for t in texts]


def test_vocabulary_is_complete():
    """Every square with a primitive root that stands in a text, and no other, before any run is made."""
    rng = random.Random(8)
    for _ in range(40):
        w = repetitive(rng) or ["a"]
        symbols, begin = tandem._laid_out([[c.encode() for c in w]])
        f = tandem.Factors(symbols)
        lz = tandem.blocks(tandem.previous_factors(f), [0], [len(w)])
        at, period = tandem.vocabulary(f, *tandem.covering_squares(f, *lz, np.full(len(lz[0]), len(w) // 2)))
        got = sorted(tuple(w[i : i + 2 * q]) for i, q in zip(at.tolist(), period.tolist()))
        primitive = lambda x: not any(len(x) % q == 0 and x == x[:q] * (len(x) // q) for q in range(1, len(x)))
        want = {tuple(w[i : i + 2 * q]) for q in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * q + 1) if w[i : i + q] == w[i + q : i + 2 * q] and primitive(w[i : i + q])}
        assert got == sorted(want)


def brute_row(doc_id, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha(lines), sha(kept))


def test_runs_query_equals_brute_force(spark):
    got = entry.op13_periodic_runs(spark, SF).collect()
    want = []
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        edited = entry.repeated(row.doc_id, [w.encode() for w in words])
        want.append(brute_row(row.doc_id, [w.decode() for w in edited]))
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[1] for w in want) > 10


def test_planted_periods():
    import zlib

    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        words = [b"%d" % i for i in range(57)]
        got = entry.repeated(doc_id, words)
        if h % 10:
            assert got == words
        else:
            a = h // 10 % 57
            p = 1 + (57 - a) // (3 + h // 10 % 8)
            assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(57)]


def test_runs_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "x " * 7), (3, "y"), (3, "y"), (4, "ha " * 30_000), (None, None), (5, "a b " * 6), (6, "\n\t z z z z z z\r\x0b\x0c")]
    df = spark.createDataFrame([(i, t, 9, "r") for i, t in rows], "doc_id long, text string, key long, runs string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in tandem.periodic_runs(df).collect()]
    want = [
        (1, 0, [], ""), (2, 0, [], ""), (None, 7, [(0, 7, 1)], "x"), (3, 1, [], "y"), (3, 1, [], "y"), (4, 30_000, [(0, 30_000, 1)], "ha"),
        (None, 0, [], ""), (5, 6, [(0, 6, 1)], "a b"), (6, 6, [(0, 6, 1)], "z"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tandem.periodic_runs(df.where("false")).count() == 0


# --- funnels


def brute_funnels(rows, funnels, percent=25):
    seen = {}
    for client, kind, t in set(rows):
        if None not in (client, kind, t):
            seen.setdefault(client, {}).setdefault(kind, []).append(t)
    out = {}
    for f in funnels:
        for client, kinds in seen.items():
            steps = [[] for _ in f.steps]
            for first in sorted(kinds.get(f.steps[0], [])):
                steps[0].append(0)
                before = first
                for k, kind in enumerate(f.steps[1:], 1):
                    on = min((t for t in kinds.get(kind, []) if t > before), default=None)
                    if on is None or on - first > f.horizon or any(before < t <= on for t in kinds.get(f.exclude, [])):
                        break
                    steps[k].append(on - before)
                    before = on
            if steps[0]:
                n = [len(s) for s in steps]
                out[f.name, client] = (*n, max(k for k, x in enumerate(n, 1) if x), *[sorted(s)[-(-percent * len(s) // 100) - 1] if s else None for s in steps[1:]])
    depth = {}
    for (name, _), v in out.items():
        depth[name, v[4]] = depth.get((name, v[4]), 0) + 1
    return sorted((*k, *v, depth[k[0], v[4]]) for k, v in out.items())


EPOCH = dt.datetime(1970, 1, 1)


def clicks(spark, rows, kind="timestamp_ntz"):
    full = [(i, c, k, None if t is None else EPOCH + dt.timedelta(microseconds=t), 1.0, "s") for i, (c, k, t) in enumerate(rows)]
    ntz = spark.createDataFrame(full, "click_id long, client_id long, kind string, arrived_at timestamp_ntz, n double, segment string")
    return ntz.withColumn("arrived_at", F.col("arrived_at").cast(kind))


@pytest.mark.parametrize("chunk, segment", [(1 << 17, funnel.SEGMENT), (7, funnel.SEGMENT), (11, 300 * funnel.SECOND)])
def test_funnels_equal_brute_force(spark, monkeypatch, chunk, segment):
    monkeypatch.setattr(funnel, "CHUNK", chunk)
    rng = random.Random(chunk)
    kinds = ["view", "click", "purchase", "error", "signup", "other", None]
    base = 1_704_067_200 * funnel.SECOND
    rows = []
    for _ in range(2500):
        client = rng.choice([7, 7, 7, 1, 2, 3, None, 9, 10])
        step = rng.choice([1, 25 * funnel.SECOND])
        t = base + rng.randrange(400) * step + rng.choice([0, funnel.SEGMENT - 100 * funnel.SECOND])
        rows.append((client, rng.choices(kinds, [6, 6, 4, 1, 2, 1, 1])[0], rng.choice([t, t, t, t, t, None])))
    rows += rows[:200]  # repeated rows
    # the horizon itself is reached, a microsecond more is not; before 1970
    for client, late in ((20, 0), (21, 1)):
        rows += [(client, "view", -5), (client, "click", 300 * funnel.SECOND - 5 + late)]
    got = sorted(map(tuple, funnel.funnel_counts(clicks(spark, rows), segment=segment).collect()))
    assert got == brute_funnels(rows, funnel.FUNNELS)


def test_funnels_of_zoned_times_and_empty_tables(spark):
    rows = [(1, "view", 0), (1, "click", 10), (1, "view", 20), (1, "purchase", 20), (1, "purchase", 21)]
    df = clicks(spark, rows, "timestamp")
    assert [tuple(r) for r in funnel.funnel_counts(df).where("funnel = 'A'").collect()] == brute_funnels(rows, funnel.FUNNELS[:1])
    assert funnel.funnel_counts(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        funnel.attempt_times(df, "client_id", "kind", "arrived_at", segment=funnel.SECOND)


def test_next_bit():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 300, 1000):
        held = rng.random(n) < 0.02
        at = np.arange(n + 1)
        want = [next((j for j in range(i, n) if held[j]), n) for i in at]
        assert funnel.Bitmap(held).next(at.copy()).tolist() == want


def test_radix_percentiles(spark):
    rng = random.Random(4)
    values = [(k, rng.choice([rng.randrange(1 << 29), 5, 1 << 20])) for k in range(6) for _ in range(1 + 40 * k)]
    df = spark.createDataFrame(values, "k long, v long").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for percent in (1, 25, 50, 100):
        got = {r.k: r.v for r in funnel.radix_percentile(df, ["k"], "v", percent, 29).collect()}
        want = {k: sorted(v for j, v in values if j == k) for k in range(6)}
        assert got == {k: v[-(-percent * len(v) // 100) - 1] for k, v in want.items()}
