"""The exact n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from palaver.llm import entry, jaccard, neardup

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_classes(rows, k=3, percent=90):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[find(i)] = find(j)
    least = {}
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for i in range(len(rows)):
        r = find(i)
        least[r] = min(least.get(r, i), i, key=order)
    return [(rows[i][0], len(sets[i]), rows[least[find(i)]][0]) for i in range(len(rows))]


def near_copies(rng, groups, size, longest=120):
    """Groups of copies with a few words changed, so that many pairs lie about the threshold."""
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, longest))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"v{rng.randrange(500)}"] * rng.randrange(2) or ["u"]
            texts.append(" ".join(w))
            base = w if g % 3 == 0 else base  # chains
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("star, block", [(70, 512), (90, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, star, block):
    monkeypatch.setattr(jaccard, "STAR", star)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(star)
    rows = near_copies(rng, 12, 24)
    rows = [(i + 10, t) for i, t in rows] + [(2, "Aa b"), (3, "aA  B"), (4, "aa b c"), (5, None), (6, " \n"), (7, ""), (None, rows[0][1]), (10, rows[0][1]), (None, None)]
    rows += [(500, "long " + " ".join(str(i) for i in range(30_000))), (501, "longer " + " ".join(str(i) for i in range(30_001)))]
    df = spark.createDataFrame([(i, t, 1, b"x", "y") for i, t in rows], "doc_id long, text string, n long, node binary, tiles string")
    got = [tuple(r) for r in jaccard.jaccard_classes(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(brute_classes(rows), key=repr)


def test_lower_threshold_and_other_shingles(spark):
    rows = near_copies(random.Random(4), 6, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_classes(df, 2, 80).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute_classes(rows, 2, 80))


def test_query_equals_brute_force_and_empty_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry.op11_ngram_jaccard_join(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute_classes(rows))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_classes(empty).count() == 0


def test_linked_sets_share_a_tile():
    """At the very threshold, with the differences where they do most harm."""
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        for n in [*range(1, 60), 200, 777, 3000]:
            whole = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2)
            x = np.unique(whole[:n])
            for more in {0, 1, n // 20, n // 10}:
                # y lacks ``lost`` of x and has ``more`` others, as many as the threshold allows
                lost = max((v for v in range(n) if 100 * (n - v) >= percent * (n + more)), default=None)
                if lost is None:
                    continue
                gone = rng.choice(n, lost, replace=False) if rng.random() < 0.5 else np.linspace(0, n - 1, lost).astype(int)
                y = np.unique(np.append(np.delete(x, gone), whole[2 * n : 2 * n + more]))
                both = len(np.intersect1d(x, y))
                if 100 * both < percent * (len(x) + len(y) - both):
                    continue
                same = len(x) == len(y) == both
                assert same or len(np.intersect1d(jaccard.tiles(x, percent), jaccard.tiles(y, percent)))
                bits = jaccard.differing_bits(jaccard.bitmap(x), jaccard.bitmap(y))
                assert bits <= len(x) + len(y) - 2 * both
                assert jaccard.can_link(np.int64(len(x)), np.int64(len(y)), np.int64(bits), percent)


def test_empty_parts_meet(monkeypatch):
    """Sets whose only common parts are empty ones meet there."""
    differ, begin = jaccard.tile_parts(jaccard.band(18, 90), 90)
    assert differ and len(begin) > differ
    low, high = int(begin[1]) // 2, int(begin[1])
    x = np.arange(low, low + 18, dtype=np.uint64)  # all in the first part
    y = np.append(x[:-1], np.uint64(low + 40))
    assert high > low + 40 and len(np.intersect1d(jaccard.tiles(x, 90), jaccard.tiles(y, 90)))


def test_random_hashes_rarely_share_tiles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 64, 900, dtype=np.uint64)) for _ in range(50)]
    keys = [set(jaccard.tiles(s, 90).tolist()) for s in sets]
    assert sum(len(a & b) for a in keys for b in keys if a is not b) == 0
    assert neardup.Shingler(3)("a b c d").tolist() == sorted(neardup.Shingler(3)("a b c d").tolist())
