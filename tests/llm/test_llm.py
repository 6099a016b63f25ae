"""Training-data operators against brute force, round trips and held-out accuracy."""

import ctypes
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palaver.llm import entry, langid, license, linededup, mixing, neardup, packing, paragraphs, quality, warc, winnowing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, th long, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, rows):
    """rows: (doc_id, text); the table has columns whose names the operators use themselves."""
    full = [(i, t, "en", "s1", len(t or ""), "x", 5, 6, "l") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n))


def edge_rows():
    return [(1, None), (2, ""), (None, "a null id"), (3, "word"), (3, "word"), (4, "\n\n"), (5, "y " * 40_000), (None, None)]


# --- 4


def brute_lines(rows, least=3, chars=20):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held.setdefault(k, []).append((i is not None, i or 0, n))
    gone = {}
    for k, at in held.items():
        if len(at) >= least:
            top = max(a[:2] for a in at)
            gone[k] = {n for known, i, n in at if (known, i) == top}
    out = []
    for n, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or n in gone[key(x)]]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines(spark):
    rng = random.Random(2)
    shared = [prose(rng, 6) for _ in range(12)] + ["short", "ÉCOLE " + "x" * 30, "école " + "x" * 30]
    rows = [(i * 7 % 60, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice([str.upper, str])(rng.choice(shared)) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += edge_rows()
    got = linededup.dedup_lines(docs(spark, rows)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(brute_lines(rows), key=order)
    kept = linededup.drop_lines(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows)
    assert kept.where("text is null").count() == 2
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


# --- 5


def brute_repeats(words, k=5):
    at = {}
    for i in range(len(words) - k + 1):
        at.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(k)})


def test_quality(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(40)] + edge_rows()
    rows.append((99, "#one two\n#one two\nthree é&|\n\n \n three"))
    got = quality.score_documents(docs(spark, rows), None).collect()
    by = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got))
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = brute_repeats(w)
        want.append((i is None, i or 0, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    assert by == sorted(want)
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.keep_good(d.withColumn("_judged", F.lit(1)), labels)
    assert kept.columns == [*d.columns, "_judged"]
    good = labels.where("quality = 1").join(kept, "doc_id", "left_semi").count() / labels.where("quality = 1").count()
    assert good > 0.9
    assert quality.keep_good(docs(spark, []), labels).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(6 * x[:, 0] - 3 + 2 * x[:, 1]))).astype(float)
    model = quality.fit_trees(x, y, monotone=(-1, 0, 1), n_trees=40)
    probe = rng.random((50, 3))
    for j, sign in ((0, -1), (2, 1)):
        line = np.linspace(0, 1, 30)
        for p in probe:
            many = np.repeat(p[None], 30, axis=0)
            many[:, j] = line
            assert (sign * np.diff(model.score(many)) >= -1e-12).all()
    assert np.corrcoef(model.score(x), y)[0, 1] > 0.4
    assert quality.fit_trees(x, np.ones(3000)) is None


# --- 6


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("p", F.lit("mine"))
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.7, "de": 0.3}}
    got = mixing.sample(d, targets, budget=0.4)
    assert got.columns == d.columns
    total = got.count()
    assert abs(total / 3000 - 0.4) < 0.04
    for column, want in targets.items():
        for level, share in want.items():
            assert abs(got.where(F.col(column) == level).count() / total - share) < 0.05
    edge = mixing.weigh(docs(spark, edge_rows()))
    assert edge.count() == len(edge_rows()) and edge.where("p < 0 or p > 1 or p is null").count() == 0
    assert mixing.sample(docs(spark, [])).count() == 0
    wide, narrow = (mixing.weigh(d, targets, columns=c).select("_row.doc_id", "n_tokens", "topic", "p", "draw", "kept").collect() for c in (None, ["doc_id"]))
    assert sorted(wide) == sorted(narrow)


def test_mixing_many_levels(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(i, prose(rng, 5 + i % 320 // 8), rng.choice(["en", "de"]), f"host{i % 320}") for i in range(6400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # the smallest sources get half of the tokens
    targets = {"source": {f"host{i}": 1 / 160 if i < 80 else 1 / 480 for i in range(320)}}
    cells = lambda: {(r.source, r.lang, r.topic): (r.n, r.tokens, r.p) for r in mixing.weigh(d, targets, budget=0.05).groupBy(*mixing.MARGINS).agg(F.count("p").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("p").alias("p")).collect()}
    got = cells()
    assert {s for s, _, _ in got} == {f"host{i}" for i in range(320)}
    expected = sum(t * p for _, t, p in got.values())
    for i in (0, 7, 79, 80, 319):
        share = sum(t * p for (s, _, _), (_, t, p) in got.items() if s == f"host{i}") / expected
        assert share == pytest.approx(targets["source"][f"host{i}"], rel=0.02)
    monkeypatch.setattr(mixing, "CELLS_AT_ONCE", 8)
    wide = cells()
    assert wide.keys() == got.keys()
    for k, (n, tokens, p) in got.items():
        assert wide[k][:2] == (n, tokens) and wide[k][2] == pytest.approx(p, rel=1e-9)
    for t in (None, {"source": {"nowhere": 1.0}}):
        few = [mixing.weigh(docs(spark, edge_rows()), t).groupBy("source").agg(F.sum("p").alias("p")).collect()]
        monkeypatch.setattr(mixing, "CELLS_AT_ONCE", 0)
        few.append(mixing.weigh(docs(spark, edge_rows()), t).groupBy("source").agg(F.sum("p").alias("p")).collect())
        monkeypatch.setattr(mixing, "CELLS_AT_ONCE", 100)
        assert few[1][0].p == pytest.approx(few[0][0].p)


# --- 7


def brute_picks(text, k=winnowing.K, w=winnowing.W, unit="token"):
    """Picks by a hash that rolls: the token that leaves goes, the one that enters comes."""
    words = list(text) if unit == "character" else re.findall(r"[^\s]+", text)
    if not words:
        return [], []
    mask = 2**64 - 1
    turn = lambda x, by: ((x << by % 64) | (x >> 64 - by % 64)) & mask
    single = [xxhash.xxh64_intdigest(word.encode(), seed=42) for word in words]
    state = 0
    for h in single[:k]:
        state = turn(state, 1) ^ h
    hashes = [state]
    for leaves, enters in zip(single, single[k:]):
        state = turn(state, 1) ^ turn(leaves, k) ^ enters
        hashes.append(state)
    hashes = [ctypes.c_int64(h).value for h in hashes]
    key = [(ctypes.c_int64(h << 27 & mask).value >> 27, -i) for i, h in enumerate(hashes)]
    at = sorted({-min(key[s : s + w])[1] for s in range(max(len(hashes) - w + 1, 1))})
    return at, [hashes[i] for i in at]


def test_winnowing(spark):
    rng = random.Random(5)
    texts = ["", "one", prose(rng, 4), "a " * 300, prose(rng, 400), "ab ba " * 90, " ".join(rng.choice("ab") for _ in range(9000)), "z" * 50_000, None]
    got = {r.doc_id: r for r in winnowing.fingerprint(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert (got[i].positions, got[i].hashes) == brute_picks(t or ""), i
        assert got[i].n_chars == len(t or "")
    few = list(enumerate([*texts[:6], "x\U0001f600y \u00e9" * 9]))
    for k, w, unit in ((1, 4, "token"), (5, 16, "token"), (7, 2, "token"), (6, 8, "character"), (16, 16, "character")):
        for r in winnowing.fingerprint(docs(spark, few), k=k, w=w, unit=unit).collect():
            assert (r.positions, r.hashes) == brute_picks(few[r.doc_id][1], k, w, unit), (r.doc_id, k, unit)


def test_shared_passages_share_a_pick(spark):
    rng = random.Random(15)
    length = winnowing.K + winnowing.W - 1
    rows = []
    for i in range(60):
        passage = " ".join(f"p{i}w{j}" for j in range(length))
        rows += [(2 * i + side, f"{prose(rng, rng.randrange(40))} {passage} {prose(rng, rng.randrange(40))}") for side in (0, 1)]
    got = {r.doc_id: set(r.hashes) for r in winnowing.fingerprint(docs(spark, rows)).collect()}
    assert all(got[2 * i] & got[2 * i + 1] for i in range(60))


def test_next_of_many_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 20)
    rng = random.Random(16)
    rows = [(i if i < 150 else None, prose(rng, 5) + f" {i}") for i in range(400)] + [(None, "same")] * 30
    got = winnowing.with_next(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    # each text is the next of one row, and the chain of the named ends at those without a name
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    named = {r.doc_id: r.next_text for r in got if r.doc_id is not None}
    assert all(named[i] == rows[i - 1][1] for i in range(1, 150))
    unnamed = {t for i, t in rows if i is None}
    assert named[0] in unnamed and sum(r.next_text == rows[149][1] for r in got if r.doc_id is None) == 1


def test_edited_texts(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 60))) for i in rng.sample(range(100_000), 4500)]
    rows[7] = (rows[7][0], None)
    got = {r.doc_id: r for r in winnowing.compare_with_edits(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for at, (i, t) in enumerate(order):
        t, other = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert got[i].edited == edited
        if at % 50 == 0:
            a, b, c = (set(brute_picks(x)[1]) for x in (t, edited, other))
            like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
            assert got[i].near_edited == pytest.approx(like(a, b)) and got[i].near_next == pytest.approx(like(a, c))
    assert winnowing.compare_with_edits(docs(spark, edge_rows())).count() == len(edge_rows())
    assert winnowing.compare_with_edits(docs(spark, [])).count() == 0


# --- 8


def test_tokens_equal_the_library():
    e = packing.encoder()
    texts = ["", " a", "a  b\n\n c\t d ", "don't  x", "é　ß", "<|endoftext|> a", "a\x1cb c", "a\nb c\n", "１２³ x", "x\x85 y", "plain words here."]
    want = [np.array(e.slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode_batch(pa.array([*texts, None])) == [*want, b""]


def test_encoders_take_little_at_once(monkeypatch):
    import public_tokenizers as public

    e = packing.Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 400)) for _ in range(60)] + [None, prose(rng, 3000), ""]
    want = [e.encode(t or "") for t in texts]
    at_once, some = [], e._encode_some
    monkeypatch.setattr(packing, "TEXT_AT_ONCE", 5000)
    monkeypatch.setattr(e, "_encode_some", lambda part: at_once.append(part.to_pylist()) or some(part))
    assert e.encode_batch(pa.array(texts)) == want and e.encode_batch(pa.array([], pa.string())) == []
    assert sum(at_once, []) == [t or "" for t in texts] and all(sum(map(len, x[1:])) <= 5000 for x in at_once)
    assert "slow" not in vars(e)  # the library's tokenizer is read only where a text needs it


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(0, 1500))) for i in range(120)] + [(600, None), (601, ""), (500, prose(rng, 9000)), (None, "x")]
    got = packing.pack(docs(spark, rows), shard_rows=50).toPandas()
    e = packing.encoder()
    ids = {i: e.encode(t or "") + np.array([1], "<u4").tobytes() for i, t in rows}
    by = {}
    for r in got.itertuples():
        i = None if np.isnan(r.doc_id) else int(r.doc_id)
        assert zlib.crc32(ids[i][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert r.doc_tokens == len(ids[i]) // 4
        by.setdefault(i, []).append((r.start, r.length))
    for i, raw in ids.items():
        place = 0
        for start, length in sorted(by[i]):
            assert start == place
            place += length
        assert place == len(raw) // 4
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 2048
    full = got.groupby("sequence_id").length.sum()
    assert full.sum() / (2048 * len(full)) > 0.9
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_fit():
    rng = random.Random(8)
    lengths = np.array(sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True))
    window, offset = packing.best_fit_decreasing(lengths, 100)
    room = []
    for n, w, o in zip(lengths, window, offset):
        fit = [r for r in room if r >= n]
        if fit:
            assert 100 - o == min(fit)  # the tightest
            room.remove(100 - o)
        else:
            assert o == 0
        room.append(100 - o - n)


# --- 9, 10


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def near_copies(rng, n, words=130):
    base = prose(rng, words).split()
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randrange(0, 16)):
            w[rng.randrange(len(w))] = rng.choice(["the", "of", f"new{rng.randrange(50)}"])
        out.append(" ".join(w))
    return out


def test_near_documents(spark):
    rng = random.Random(9)
    texts = near_copies(rng, 220) + near_copies(rng, 30, 12) + [prose(rng, 50) for _ in range(40)] + ["", None, "one", "one", "ONE", "  \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in neardup.near_documents(docs(spark, rows), k=2).collect()}
    sets = [shingle_set(t, 2) for t in texts]
    want = brute_groups(sets)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i
    kept = neardup.keep_first(docs(spark, rows), k=2)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if want[i] == i]


def test_near_edge_cases(spark):
    rows = edge_rows()
    got = neardup.keep_first(docs(spark, rows), k=5)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == [
        (False, 1, ""), (False, 2, ""), (False, 3, "word"), (False, 4, "\n\n"), (False, 5, "y " * 40_000), (True, 0, ""), (True, 0, "a null id"),
    ]
    assert neardup.keep_first(docs(spark, []), k=5).count() == 0


def test_prune_keeps_what_reaches_the_bound():
    rng = np.random.default_rng(1)
    for percent in (55, 80):
        hits = rng.random((4000, neardup.SIGNATURE)) < percent / 100
        sig = [(np.where(h, 1, 2)).astype(np.uint16).tobytes() for h in hits]
        one = np.ones(neardup.SIGNATURE, np.uint16).tobytes()
        assert len(neardup.plausible(sig, [one] * len(sig), percent)) >= 3999


def test_paragraphs(spark):
    rng = random.Random(10)
    passages = near_copies(rng, 25, 60) + near_copies(rng, 3, 90)
    rows = []
    for i in range(40):
        lines = [prose(rng, rng.randrange(1, 80)) for _ in range(3)]
        if i < len(passages):
            lines.insert(rng.randrange(4), passages[i])
        rows.append((i, "\n".join(lines)))
    rows += [(41, rows[39][1]), (42, None), (43, "")]
    got = {(r.doc_id, r.paragraph): r for r in paragraphs.repeats(docs(spark, rows)).collect()}
    items = [(i, p, x) for i, t in rows for p, x in enumerate((t or "").split("\n")) if len(x.split()) >= paragraphs.MIN_WORDS]
    want = brute_groups([shingle_set(x, 5) for _, _, x in items])
    for at, (i, p, _) in enumerate(items):
        if want.count(want[at]) > 1:
            first = items[want[at]]
            r = got.pop((i, p))
            assert (r.group_doc_id, r.group_paragraph, r.kept, r.group_size) == (first[0], first[1], want[at] == at, want.count(want[at]))
    assert not got
    left = paragraphs.remove_repeats(docs(spark, rows))
    assert left.count() == len(rows) and left.where("doc_id = 41").first().text.count("\n") < 3
    assert paragraphs.repeats(docs(spark, [])).count() == 0
    assert paragraphs.tuned().missed(0.8) <= paragraphs.MISS


def brute_passages(rows):
    """Places of the RUN-word runs that stand in two or more documents, by document."""
    held = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for p in range(len(w) - paragraphs.RUN + 1):
            held.setdefault(tuple(w[p : p + paragraphs.RUN]), []).append((i, p))
    out = {}
    for at in held.values():
        if len({i for i, _ in at}) > 1:
            for i, p in at:
                out[i, p] = min(at)
    return out


def found_passages(spark, rows):
    """Rows by document, and each place they cover with the place that it is a copy of."""
    got = paragraphs.passages(docs(spark, rows)).collect()
    cover = {}
    for r in got:
        assert r.kept == ((r.doc_id, r.start) == (r.group_doc_id, r.group_start))
        for p in range(r.n_words - paragraphs.RUN + 1):
            assert (r.doc_id, r.start + p) not in cover
            cover[r.doc_id, r.start + p] = (r.group_doc_id, r.group_start + p)
    return got, cover


def test_passages_over_line_breaks(spark):
    rng = random.Random(12)
    w = prose(rng, 60).split()
    broken = "\n".join(" ".join(w[i : i + 20]) for i in (0, 20, 40))
    rows = [(1, f"{prose(rng, 9)}\n{broken}\n{prose(rng, 30)}"), (2, f"{prose(rng, 30)}\n{' '.join(w[:33])}\n\n{' '.join(w[33:]).upper()}"), (3, prose(rng, 200))]
    assert paragraphs.repeats(docs(spark, rows)).count() == 0
    got, cover = found_passages(spark, rows)
    assert sorted((r.doc_id, r.start, r.n_words, r.group_doc_id, r.group_start, r.group_size, r.kept) for r in got) == [(1, 9, 60, 1, 9, 2, True), (2, 30, 60, 1, 9, 2, False)]
    rows += [(i, f"{prose(rng, rng.randrange(40))}\n{broken}") for i in range(4, 24)] + [(30, rows[2][1]), (31, "y " * 300), (32, "y " * 90), (33, None), (34, "")]
    assert found_passages(spark, rows)[1] == brute_passages(rows)
    assert paragraphs.passages(docs(spark, edge_rows())).count() == 0
    assert paragraphs.passages(docs(spark, [])).count() == 0


def test_passages_inside_long_lines(spark):
    rng = random.Random(13)
    w = prose(rng, 55)
    rows = [(1, f"{prose(rng, 90)} {w} {prose(rng, 70)}"), (2, f"{prose(rng, 20)} {w} {prose(rng, 200)}"), (3, prose(rng, 300))]
    rows += [(i, f"{prose(rng, rng.randrange(60))} {' '.join(w.split()[: rng.randrange(45, 56)])} {prose(rng, 60)}") for i in range(4, 20)]
    assert paragraphs.repeats(docs(spark, rows)).where("doc_id <= 3").count() == 0
    cover = found_passages(spark, rows)[1]
    assert {(1, 90), (2, 20)} <= set(cover) and cover == brute_passages(rows)


# --- 1, 2, 3


def test_license(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, f"some words here\n{x}\nmore") for i, x in enumerate(lines)] + [(10, "the license of the driver was valid"), (11, "Licensed under the Example Company Source License, version 1.")]
    got = {r.doc_id: r for r in license.scan_documents(docs(spark, rows + [(20, None), (21, "")])).collect()}
    assert [[(f.license, f.paragraph, f.start, f.confirmed) for f in got[i].found] for i in range(4)] == [[(x, 1, 16, True)] for x in ("Apache-2.0", "MIT", "CC-BY-NC", "GPL")]
    assert got[10].found == [] and [f.license for f in got[11].found] == ["unknown"]
    assert (got[20].n_paragraphs, got[21].n_paragraphs) == (1, 1)
    assert license.scan_documents(docs(spark, [])).count() == 0


def test_license_without_cue():
    model = license.fit()
    named = {"Creative Commons Attribution 4.0 International": "CC-BY", "CC BY-SA 4.0": "CC-BY-SA", "GNU General Public License": "GPL", "available under the GNU GPL v3": "unknown"}
    wrapped = "You should have received a copy of the GNU Affero General Public\nsome other words"
    for line, name in (named | {wrapped: "AGPL"}).items():
        found = license.scan(f"words before\n{line}\nwords after", model)[1]
        assert [(f[0], f[3]) for f in found] == [(1, name)], line
    for line in ("Der Mann ging mit der Frau", "mit", "The.", "of the house on the hill", "the terms of the agreement are free"):
        assert license.scan(line, model)[1] == [], line
    rng, seen = np.random.default_rng(7), []
    for text in license.TEMPLATES.values():
        for line in text.split("\n"):
            altered = [license._altered(rng, line) for _ in range(20)]
            seen += [bool(license.scan(v, model)[1]) for v in altered if not license.cued(v)]
    assert sum(seen) / len(seen) > 0.6


def test_license_families():
    model, rng = license.fit(), np.random.default_rng(99)
    right = total = 0
    for name, text in license.TEMPLATES.items():
        for line in text.split("\n"):
            for _ in range(4):
                found = license.scan(license._altered(rng, line), model)[1]
                total += 1
                right += bool(found) and found[0][3] in (name, license.UNKNOWN)
    assert right / total > 0.85


def test_language(spark):
    got = entry.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = got[got.held_out & (got.text.str.split().str.len() >= 5)]
    assert (held.lang == held.lang_pred).mean() > 0.95
    model = langid.fit(docs(spark, [(i, t) for i, t in edge_rows() if t]))
    rows = {(r.doc_id, r.lang_pred) for r in langid.predict(docs(spark, [*edge_rows(), (8, "12 - 3")]), model).collect()}
    assert rows == {(1, "und"), (2, "und"), (None, "en"), (3, "en"), (4, "und"), (5, "en"), (None, "und"), (8, "und")}
    assert langid.fit(docs(spark, [])) is None
    assert langid.predict(docs(spark, [(1, "abc")]), None).first().lang_pred == "und"


def test_warc(spark):
    page = "<html lang='FR'><head><title>A &amp; B</title></head><body><p>one <b>two</b></p><script>x('<p>')</script><a href=\"/q?a=1&amp;b\">l</a><div>three\n four</div><!-- c --></body></html>"
    pages = spark.createDataFrame([(1, "http://e/x", page), (2, None, None), (None, "http://e/y", "plain"), (1, "http://e/x", page)], "page_id long, url string, html string").withColumn("record", F.lit(1))
    responses = warc.respond(pages)
    sources = [list(warc.parse_records(bytes(r.record))) for r in responses.collect()]
    assert all(len(s) == 1 for s in sources)
    ids = {dict(h)["WARC-Record-ID"]: (dict(h), b) for [(h, b)] in sources}
    got = warc.derive(responses).collect()
    assert len(got) == 8
    for r in got:
        [(headers, block)] = list(warc.parse_records(bytes(r.record)))
        h = dict(headers)
        source, http = ids[h["WARC-Refers-To"]]
        assert warc.record_bytes(headers, block) == bytes(r.record)
        assert h["WARC-Target-URI"] == source["WARC-Target-URI"] and h["WARC-Block-Digest"] == warc.digest(block)
        if r.record_type == "metadata":
            assert f"source-payload-digest: {source['WARC-Payload-Digest']}".encode() in block
            assert b"source-header: Content-Type: text/html; charset=utf-8" in block
        elif r.page_id == 1:
            assert block.decode() == "one two\nl\nthree four".replace("l\nthree four", "l\nthree\nfour")
    assert len({r.record_id for r in got}) == 6
    meta = next(bytes(r.record) for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert b"title: A & B\r\nlanguage: fr\r\nlinks: 1\r\noutlink: /q?a=1&b\r\n" in meta
    assert warc.derive(warc.respond(pages.limit(0))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) and set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns
