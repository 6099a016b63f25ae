"""The pipeline from end to end against plain Python, over edge cases and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_llm import brute_groups, brute_lines, edge_rows, near_copies, prose, shingle_set

import corpus_pipeline
from palaver.llm import mixing, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, p double, th long, n_tokens string, _row string, _judged int"


def table(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with the operators' own."""
    full = [(i, t, lang, source, len(t or ""), "x", 0.5, 7, "n", "r", 1) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(rng):
    stock = [prose(rng, 8) for _ in range(5)]
    texts = [prose(rng, rng.randrange(12, 160)) for _ in range(90)]
    texts += [f"{prose(rng, 60)}\n{rng.choice(stock)}\n{prose(rng, 60)}" for _ in range(40)]
    for _ in range(4):
        texts += near_copies(rng, 9)
    junk = [" ".join(rng.choice(["#x", "$$", "&|", "<a>"]) + str(rng.randrange(900)) for _ in range(rng.randrange(12, 90))) for _ in range(90)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, t) for i, t in enumerate(junk)]
    rows += [(i + 5000 if i is not None else None, t) for i, t in edge_rows()]
    rows += [(6000, texts[3]), (6000, texts[3]), (None, prose(rng, 70)), (6001, prose(rng, 4000))]
    made = {}
    for row in rows:  # equal rows have equal levels
        made.setdefault(row, (*row, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])))
    return [made[row] for row in rows], len(texts), len(junk)


def brute_probabilities(rows):
    """Cells' draw probabilities by raking, in plain Python."""
    cells = defaultdict(int)
    for _, text, lang, source in rows:
        cells[key(text, lang, source)] += words(text)
    cells = {c: n for c, n in cells.items() if n}
    weight = {c: float(n) for c, n in cells.items()}

    def sums(held, m):
        out = defaultdict(float)
        for c, w in held.items():
            out[c[m]] += w
        return out

    goals = []
    for m in range(3):
        goal = {level: n**mixing.ALPHA for level, n in sums(cells, m).items()}
        goals.append({level: g / sum(goal.values()) for level, g in goal.items()})
    for _ in range(mixing.ROUNDS):
        for m in range(3):
            had = sums(weight, m)
            weight = {c: w * goals[m][c[m]] / had[c[m]] for c, w in weight.items()}
    p = dict.fromkeys(cells, 0.0)
    for _ in range(mixing.CAP_ROUNDS):
        free = sum(weight[c] for c in cells if p[c] < 1)
        left = mixing.BUDGET * sum(cells.values()) - sum(n for c, n in cells.items() if p[c] >= 1)
        p = {c: 1.0 if p[c] >= 1 else max(0.0, min(1.0, weight[c] * left / (free * cells[c]))) for c in cells}
    return p


def words(text):
    return len([w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w])


def key(text, lang, source):
    n, size = words(text), max(len(text or ""), 1)
    if not n:
        topic = "blank"
    elif 25 * sum(c in "#*$%&|<>{}=" for c in text) >= size:
        topic = "markup"
    elif 10 * sum(c in "0123456789" for c in text) >= size:
        topic = "figures"
    else:
        topic = "note" if n < 100 else "article" if n < 1000 else "book"
    return source or mixing.NONE, lang or mixing.NONE, topic


def draw(doc_id, text):
    name = str(doc_id) if doc_id is not None else hashlib.sha256(text.encode()).hexdigest()
    return int(hashlib.sha256(f"0:{name}".encode()).hexdigest()[:13], 16) / 2**52


def order(row):
    return row[0] is None, row[0] or 0, row[1] or ""


def test_run_equals_plain_python(spark, tmp_path):
    rows, n_good, n_junk = corpus(random.Random(31))
    folder = f"file://{tmp_path}"
    docs = table(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n_good)] + [(1000 + i, 0, 0) for i in range(n_junk)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")

    # the verdicts by text; their trees are compared with a plain walk in test_robust
    texts = sorted({t for _, t, _, _ in rows if t is not None})
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    judged = quality.score_documents(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model).collect()
    good = {texts[r.doc_id] for r in judged if r.kept}
    assert any(t in good for t in texts) and not all(t in good for t in texts)
    left = [r for r in rows if r[1] in good]
    left = [(i, t, *r[2:]) for r, (i, t, _, _) in zip(left, brute_lines([r[:2] for r in left]))]
    left = sorted({(i, t): (i, t, *rest) for i, t, *rest in sorted(left, key=order)}.values(), key=order)
    first = brute_groups([shingle_set(t, 5) for _, t, _, _ in left])
    left = [r for n, r in enumerate(left) if first[n] == n]
    assert 20 < len(left) < len(texts)

    stage_docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage_docs = stage(spark, stage_docs, folder)
        assert stage_docs.columns == docs.columns, name
    found = sorted(((r.doc_id, r.text) for r in stage_docs.select("doc_id", "text").collect()), key=order)
    assert found == sorted(((i, t) for i, t, _, _ in left), key=order)
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in stage_docs.collect()]
    p = brute_probabilities(kept)
    want = {i: t for i, t, lang, source in kept if draw(i, t) < p.get(key(t, lang, source), 1.0)}
    assert len(want) < len(kept)

    got = corpus_pipeline.run(spark, folder).toPandas()
    ids = {i: packing.encoder().encode(t) + np.array([1], "<u4").tobytes() for i, t in want.items()}
    pieces = defaultdict(list)
    for r in got.itertuples():
        pieces[None if np.isnan(r.doc_id) else int(r.doc_id)].append(r)
    assert pieces.keys() == ids.keys()
    for i, raw in ids.items():
        place = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(raw) // 4
            assert zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            place += r.length
        assert place == len(raw) // 4
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    table(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == 0 and "sequence_id" in got.columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where(F.lit(True)).count() == 0, name
