"""Malformed input, odd types and clashing names, planted passages, and models against plain walks."""

import gzip
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import common, entry, langid, license, linededup, packing, paragraphs, quality, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<html ", "<a x ", "<script ", "<!", "<?", "<!--", '<a href="', "</title ", "<head><title"])
def test_pages_of_unclosed_tags_take_time_in_proportion(unit):
    def seconds(size):
        page = unit * (size // len(unit))
        start = time.process_time()
        shown, body = warc._shown(page)
        warc.page_facts(shown, body)
        warc.page_text(body)
        return time.process_time() - start

    assert seconds(1_000_000) < max(1.0, 40 * seconds(100_000))


def test_broken_records_give_error_rows():
    good = warc.response("http://x/", "<title>t</title><p>b", 1)
    broken = {
        "no length": b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n",
        "wrong length": b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9999\r\n\r\nabc\r\n\r\n",
        "no number": b"WARC/1.1\r\nContent-Length: x\r\n\r\nabc\r\n\r\n",
        "no field": b"WARC/1.1\r\njust words\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
        "garbage": b"\x00\xff garbage\n",
        "no end": b"WARC/1.1\r\nContent-Length: 3",
    }
    for name, data in broken.items():
        found = warc.derivatives(data + good if name not in ("no end",) else data)
        assert isinstance(found[0], warc.Broken), name
        if name != "no end":
            assert [f[0] for f in found[1:]] == ["metadata", "conversion"], name
    loose = good.replace(b"WARC-Type: response", b"WARC-Type:response").replace(b"WARC-Date: ", b"X-Odd: \xff\xfe\r\nWARC-Date:\t")
    assert [f[0] for f in warc.derivatives(loose)] == ["metadata", "conversion"]


def test_charsets_and_encodings():
    page = "<title>Ä</title><p>grüße"
    raw = page.encode("latin-1")
    chunked = b"5\r\n" + raw[:5] + b"\r\n" + f"{len(raw) - 5:x}".encode() + b"\r\n" + raw[5:] + b"\r\n0\r\n\r\n"
    head = ["Content-Type: text/html; charset=ISO-8859-1"]
    assert warc.page_of(head, raw) == page
    assert warc.page_of([*head, "Content-Encoding: gzip"], gzip.compress(raw)) == page
    assert warc.page_of([*head, "content-encoding: deflate"], zlib.compress(raw)) == page
    assert warc.page_of([*head, "Transfer-Encoding: chunked"], chunked) == page
    assert warc.page_of(["Content-Type: text/html; charset=none-such"], page.encode()) == page


def test_reads_files_of_records(spark, tmp_path):
    records = [warc.response(f"http://x/{i}", f"<p>page {i}", i) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"junk\n" + b"".join(records))
    rows = warc.derive(warc.read_files(spark, f"file://{tmp_path}")).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in rows} == {"metadata": 6, "conversion": 6, "error": 1}


def test_quality_keeps_columns_of_any_name(spark):
    good = "a plain line of ten words or more stands here today"
    rows = spark.createDataFrame([(1, good, 5, 6, 7), (2, None, 1, 1, 1), (3, "short", 1, 1, 1)], "doc_id long, text string, _Judged int, _row int, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.keep_good(rows, labels)
    assert got.columns == rows.columns
    assert [tuple(r) for r in got.collect()] == [(1, good, 5, 6, 7)]


def test_flat_trees_score_as_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.4) & (x[:, 4] < 0.7)).astype(float)
    model = quality.fit_trees(x, y, n_trees=12)

    def walk(row):
        total = model.bias
        for t in range(len(model.leaf)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.split[t, node] else 1)
            total += model.leaf[t, node - model.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(row) for row in x])
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.95  # bad rows go, good rows stay
    j = list(quality.FEATURES).index("repeat_share")  # constrained to fall
    grid = np.repeat(x[:1], 50, axis=0)
    grid[:, j] = np.linspace(0, 1, 50)
    assert (np.diff(model.score(grid)) <= 1e-12).all()


def test_packing_of_named_and_equal_documents(spark):
    rows = spark.createDataFrame([("a", "some words"), (None, "some words"), ("é", None)] + [("same", "equal text")] * 40, "doc_id string, text string")
    got = packing.pack(rows, shard_rows=5)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    found = got.toPandas()
    assert len(found) == 43 and (found.doc_id == "same").sum() == 40
    same = found[found.doc_id == "same"]
    assert (same.sequence_id // 2**32).nunique() > 4  # not in one shard
    assert not found.duplicated(["sequence_id", "offset"]).any()


def test_passages_inside_lines_of_other_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    said = lambda n: rng.choices(words, k=n)
    rows, planted = [], set()
    for p in range(12):
        passage = said(55)
        for copy in range(2 + p % 3):
            inside = said(60 + 7 * copy) + passage + said(90 - 5 * copy)
            if p % 2:  # broken over lines elsewhere in each copy
                for at in range(9 + copy, len(inside), 23 + copy):
                    inside[at] += "\n"
            rows.append((len(rows), " ".join(inside).replace("\n ", "\n") if p % 2 == 0 else " ".join(inside)))
            planted.add(rows[-1][0])
    rows += [(len(rows) + i, " ".join(said(150))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraphs.passages(docs).toPandas()
    even = {i for i in planted if "\n" not in rows[i][1]}
    assert even <= set(got.doc_id) and set(got.doc_id) <= planted
    assert (got.n_words >= paragraphs.RUN).all()
    for r in got.itertuples():  # both places hold the same words
        a, b = (rows[i][1].lower().split()[at : at + r.n_words] for i, at in ((r.doc_id, r.start), (r.group_doc_id, r.group_start)))
        assert a == b


def test_line_runs_do_not_depend_on_batches(spark):
    rng = random.Random(2)
    lines = [f"line number {i} with enough letters" for i in range(60)]
    rows = [(i if i % 9 else None, "\n".join(rng.choices(lines, k=12))) for i in range(80)] + [(81, None), (82, ""), (5, rng.choice(lines))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for batches in (1, 2, 5, 11):
        got = linededup.dedup_lines(docs, batches=batches).toPandas()
        got = sorted(map(repr, got.to_numpy().tolist()))
        want = want or got
        assert got == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_licences_neither_templates_nor_drawn():
    written = {
        "MIT": ["Distributed under the MIT License. See LICENSE for more information.", "Copyright (c) 2019 Jane Roe. Released under the MIT license", "MIT License", "license: mit"],
        "Apache-2.0": ["Copyright 2021 The Example Authors. Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Apache 2.0"],
        "GPL": ["This software is distributed under the GNU General Public License v3", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2", "GPLv3"],
        "LGPL": ["This library is distributed under the GNU Lesser General Public License, version 2.1 or later"],
        "AGPL": ["The server is licensed under the GNU Affero General Public License v3"],
        "BSD": ["Neither the name of the University nor the names of its contributors may be used to endorse or promote products", "All code is released under the BSD 3-Clause License, see below."],
        "CC-BY": ["All text is licensed under a Creative Commons Attribution 4.0 International License"],
        "CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply"],
        "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    }
    model = license.fit()
    found = [(name, license.scan(line, model)[1]) for name, lines in written.items() for line in lines]
    right = sum(bool(f) and f[0][3] == name for name, f in found)
    assert right >= 0.9 * len(found)


def test_licence_probabilities_are_calibrated():
    model, rng = license.fit(), np.random.default_rng(99)
    names = [*model.names, None]
    score, hit = [], []
    for name, text in license.TEMPLATES.items():
        for line in text.split("\n"):
            p = model.probabilities([license.grams(license.word_ids(license._altered(rng, line)))])[0]
            score.append(p.max())
            hit.append(names[int(p.argmax())] == name)
    assert abs(np.mean(score) - np.mean(hit)) < 0.05 and np.mean(hit) > 0.9


def test_every_language_is_learned():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.random((60, 8)).astype(np.float32), np.ones((60, 1), np.float32)])
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0)
    w, b = langid.fit_svm(x, y)
    assert ((x[:, :-1] @ w + b > 0) == (y > 0)).mean() > 0.95


def test_files_are_owned_and_released(spark):
    df = common.materialise(spark.range(100).select(F.col("id")), "owned", rows=100)
    assert df._palaver_rows == 100 and df.rdd.getNumPartitions() == 1
    path = df._palaver_path.removeprefix("file:")
    import os

    assert os.path.isdir(path.replace("//", "/"))
    common.forget(df)
    assert not os.path.isdir(path.replace("//", "/"))


@pytest.mark.parametrize("stage", [False, True])
def test_registered_line_dedup_runs_its_levels(spark, monkeypatch, stage):
    """On the smallest table too, batches are anti-joined with runs, and runs are compacted to a higher level."""
    import corpus_pipeline

    seen = {"batches": 0, "anti": 0, "merged": [], "less": 0}
    add, merge = linededup.RunStore.add_batch, linededup.RunStore._merge

    def adding(self, held):
        keys = held.select("k1", "k2").distinct().count()
        seen["batches"] += 1
        seen["anti"] += len(self.runs())
        write = self._write

        def writing(run, level):
            if level == 0:
                seen["less"] += run.count() < keys
            return write(run, level)

        self._write = writing
        add(self, held)
        self._write = write

    def merging(self, a, b, level):
        seen["merged"].append(level)
        return merge(self, a, b, level)

    monkeypatch.setattr(linededup.RunStore, "add_batch", adding)
    monkeypatch.setattr(linededup.RunStore, "_merge", merging)
    if stage:
        corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
    else:
        entry.op4_line_dedup(spark, SF).count()
    assert seen["batches"] >= 4 and seen["anti"] >= 4
    assert {1, 2} <= set(seen["merged"])  # two levels of compaction
    assert seen["less"]  # an anti-join took keys out


def test_gzip_members_take_time_in_proportion():
    member = gzip.compress(random.Random(1).randbytes(5_000))

    def seconds(members):
        data = member * members
        start = time.process_time()
        assert sum(map(len, warc._members(data))) == 5_000 * members
        return time.process_time() - start

    seconds(100)
    assert seconds(8_000) < 16 * max(seconds(1_000), 0.02)  # 40 MB against 5 MB


def test_odd_gzip_files():
    long = gzip.compress(b"x" * 3_000_000 + random.Random(2).randbytes(200_000))
    assert [len(m) for m in warc._members(long + gzip.compress(b"") + gzip.compress(b"end"))] == [3_200_000, 0, 3]
    assert list(warc._members(b"")) == [b""] and list(warc._members(b"plain")) == [b"plain"]
    cut = list(warc._members(gzip.compress(b"whole") + long[: len(long) // 2]))
    assert cut[0] == b"whole" and len(cut) == 2 and len(cut[1]) < 3_200_000
    broken = list(warc._members(gzip.compress(b"whole") + b"\x1f\x8b" + b"\xff" * 50))
    assert broken[0] == b"whole" and broken[1].startswith(b"gzip: ")
    assert list(warc._members(gzip.compress(b"whole") + b"padding")) == [b"whole"]
