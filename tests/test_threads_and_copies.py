"""Reply chains by pointer doubling and copied runs by seeds, against plain walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palaver.operators import copyscan, threads

EDGES = "post_id string, comment_id string, parent_id string, idx int"


def walked(known, post, comment, parent):
    chain, seen = [comment], {comment}
    while parent and (post, parent) in known and parent not in seen:
        chain.append(parent)
        seen.add(parent)
        parent = known[post, parent]
    return chain[::-1]


def plain_chains(rows):
    known = {(post, c): p for post, c, p, _ in rows if c}
    return {(post, i): walked(known, post, c, p) for post, c, p, i in rows}


def chains(found):
    return {(r.post_id, r.idx): r.chain for r in found.collect()}


def test_one_very_large_thread(spark):
    """200,000 comments, a chain of 5,000, a cycle with a tail of 390, and a comment with very many answers."""
    rng, n, rows = random.Random(3), 200_000, []
    for i in range(n):
        if i < 5000:
            parent = f"c{i - 1}" if i else None
        elif i < 5010:
            parent = f"c{5000 + (i - 4999) % 10}"
        elif i < 5400:
            parent = f"c{i - 1}"
        else:
            parent = rng.choice([f"c{rng.randrange(i)}", "unknown", None, f"c{i - 1}" if i % 1000 else "c3", "c7"])
        rows.append(("p", f"c{i}", parent, i))
    rows += [("q", "a", None, 0), ("q", "b", "a", 1)]
    wanted = [("p", i) for i in {4999, 5003, 5399, *rng.sample(range(n), 300)}] + [("q", 1)]
    edges = spark.createDataFrame(rows, EDGES).repartition(4)
    start = time.time()
    got = chains(threads.reply_chains(edges, spark.createDataFrame(wanted, "post_id string, idx int")))
    took = time.time() - start
    every = plain_chains(rows[:5400]) | {k: None for k in wanted}
    known = {(p, c): up for p, c, up, _ in rows}
    want = {(p, i): every[p, i] or walked(known, p, *((f"c{i}", known[p, f"c{i}"]) if p == "p" else ("b", "a"))) for p, i in wanted}
    assert got == want and max(map(len, want.values())) >= 5000
    assert took < 120  # about 30 s on a machine of its own


@pytest.mark.parametrize("size", [0, 4, 64])
def test_chains_of_any_size_are_equal(spark, monkeypatch, size):
    monkeypatch.setattr(threads, "WALKED", size)
    rng, rows = random.Random(size), []
    for t in range(50):
        n = rng.randrange(1, 14)
        for i in range(n):
            rows.append((f"t{t}", rng.choice([f"c{i}"] * 8 + ["c0", "", None]), rng.choice([f"c{rng.randrange(n)}", f"c{max(0, i - 1)}", None, "", "zz"]), i))
    edges = spark.createDataFrame(rows, EDGES)
    want = plain_chains(rows)
    assert chains(threads.reply_chains(edges)) == want
    few = [k for k in want if rng.random() < 0.3]
    got = chains(threads.reply_chains(edges, spark.createDataFrame(few + few, "post_id string, idx int")))
    assert got == {k: want[k] for k in few}
    assert threads.reply_chains(edges.where("false")).count() == 0


def test_last_chain_in_the_threads_order(spark):
    # b answers c, which is later in the thread
    rows = [("p", "a", None, 0), ("p", "b", "c", 1), ("p", "c", "a", 2), ("p", "d", "b", 3), ("p", "e", "a", 4)]
    targets = spark.createDataFrame([("p", 1), ("p", 3)], "post_id string, idx int")
    got = threads.last_target_chain(spark.createDataFrame(rows, EDGES), targets).collect()
    assert sorted((r.new_idx, r.comment_id) for r in got) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def brute_runs(r, s, n):
    out = set()
    for i in range(len(r)):
        for j in range(len(s)):
            if i and j and r[i - 1] == s[j - 1]:
                continue
            k = 0
            while i + k < len(r) and j + k < len(s) and r[i + k] == s[j + k]:
                k += 1
            if k >= n:
                out.add((i, i + k, j, k))
    return out


def copies(spark, rng, alphabet, longest, phrase=()):
    texts = []
    for _ in range(40):
        w = [rng.choice(alphabet) for _ in range(rng.randrange(longest))]
        at = rng.randrange(len(w) + 1)
        texts.append(w[:at] + list(phrase) + w[at:])
    texts[3] = None
    r = spark.createDataFrame([(i, w, "x") for i, w in enumerate(texts)], "doc long, words array<string>, seed string")
    s = spark.createDataFrame([(i, w) for i, w in enumerate(texts[::3])], "item long, words array<string>")
    return texts, r, s


@pytest.mark.parametrize("n, alphabet, most, salts", [(1, "abcd", 0, 3), (2, "ab", 0, 32), (3, "abc", 300_000, 32), (8, "ab", 0, 4), (8, "ab", 300_000, 32), (5, "a", 0, 2)])
def test_runs_by_seeds(spark, monkeypatch, n, alphabet, most, salts):
    monkeypatch.setattr(copyscan, "BROADCAST_SEEDS", most)
    monkeypatch.setattr(copyscan, "SALTS", salts)
    texts, r, s = copies(spark, random.Random(n), alphabet, 40)
    have = {}
    for x in copyscan.runs(r, s, ["doc"], ["item"], [], n).collect():
        have.setdefault((x.doc, x.item), []).append((x.response_start, x.response_end, x.source_start, x.tokens))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[::3]):
            assert sorted(have.get((i, j), [])) == sorted(brute_runs(a or [], b or [], n))


def test_stock_phrase_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(copyscan, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(copyscan, "BROADCAST_KEYS", 0)
    phrase = [f"stock{i}" for i in range(20)]
    texts, r, s = copies(spark, random.Random(9), [f"w{i}" for i in range(5000)], 60, phrase)
    got = copyscan.longest(copyscan.runs(r, s, ["doc"], ["item"], [], 8), ["doc", "item"]).collect()
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[::3]) if a and b}
    assert {(x.doc, x.item) for x in got} == want and min(x.longest for x in got) >= 20


def test_seeds_are_sparse_and_shared(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10_000)}" for _ in range(4000)]
    df = spark.createDataFrame([(0, words), (1, words[100:108])], "id long, words array<string>")
    got = copyscan.seeds(df, ["id"], F.col("words"), 8, "at").collect()
    whole = {(x.at, x.seed) for x in got if x.id == 0}
    assert len(whole) < 0.45 * 4000
    assert {(x.at + 100, x.seed) for x in got if x.id == 1} <= whole


def test_greedy_choice(spark):
    rng, rows = random.Random(6), []
    for key in range(30):
        for _ in range(rng.randrange(1, 25)):
            at, n = rng.randrange(40), rng.randrange(1, 12)
            rows.append((key, at, at + n, n, rng.randrange(3)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc long, response_start long, response_end long, tokens long, source_rank int")
    got = {x.doc: [(-c.o, c.s, c.e, c.source_rank) for c in x.chosen] for x in copyscan.greedy(df, ["doc"]).collect()}
    for key in range(30):
        chosen = []
        for k, s, e, n, rank in sorted({r for r in rows if r[0] == key}, key=lambda r: (-r[3], r[1], r[2], r[4])):
            if len(chosen) < 3 and all(e <= c[1] or c[2] <= s for c in chosen):
                chosen.append((n, s, e, rank))
        assert got[key] == chosen
