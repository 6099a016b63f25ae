"""The archive source: planning, file systems, split members and the linear object scanner."""

import io
import json
import random
import time
import zipfile

import pytest

from palaver.sources import tables, zipjsonl


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, False, 0, -1.5e3, 12])
    if kind in (1, 2, 3):
        return "".join(rng.choice('ab\\"{}[],: \n\té€😀') for _ in range(rng.randrange(9)))
    if kind in (4, 5):
        return {random_value_key(rng): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def random_value_key(rng):
    return "".join(rng.choice('xyz\\"{}:,') for _ in range(rng.randrange(1, 6)))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_object_scanner_equals_the_parser(chunk):
    rng = random.Random(chunk)
    for _ in range(150):
        whole = {random_value_key(rng): random_value(rng) for _ in range(rng.randrange(7))}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.3:
            text = " \n" + text + " \n"
        got = [(k, json.loads(v)) for k, v in zipjsonl.object_entries(io.BytesIO(text.encode()), chunk)]
        assert got == list(whole.items())


@pytest.mark.parametrize("text", ["[1]", "", " ", "3", '{"a": 1', '{"a": {"b": 1}', '{"a": "x}', 'x{"a": 1}', '{"a" 1}', '{"a": 1: 2}'])
def test_broken_objects_are_errors(text):
    with pytest.raises(ValueError):
        for _, v in zipjsonl.object_entries(io.BytesIO(text.encode()), 3):
            json.loads(v)


def test_a_large_value_takes_time_in_proportion():
    def seconds(size):
        text = b'{"a": 1, "big": [' + b'{"k": "v\\\\\\"", "n": [1, 2]}, ' * (size // 28) + b'0], "z": 2}'
        start = time.process_time()
        assert [k for k, _ in zipjsonl.object_entries(io.BytesIO(text))] == ["a", "big", "z"]
        return time.process_time() - start

    seconds(1_000_000)
    assert seconds(40_000_000) < 16 * max(seconds(4_000_000), 0.05)


def make(folder, name, lines, meta, how=zipfile.ZIP_DEFLATED, inside="corpus/"):
    with zipfile.ZipFile(folder / name, "w", how) as z:
        z.writestr(f"{inside}utterances.jsonl", "".join(lines))
        z.writestr(f"{inside}conversations.json", json.dumps(meta))


def utterance(i):
    return json.dumps({"id": f"u{i}", "text": "é" * (i % 7), "speaker": "s"}, ensure_ascii=False)


@pytest.mark.parametrize("how", ["local", "file", "other"])
def test_archives_by_file_system(spark, tmp_path, monkeypatch, how):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        lines = [utterance(1000 * n + i) + "\n" + rng_blank for i, rng_blank in zip(range(40), ["", "\n", " \r\n"] * 14)]
        make(folder, f"b{n}.zip", lines, {f"c{n}-{i}": {"title": f"t{i}"} for i in range(30)}, inside="x/" if n else "")
    (folder / "note.txt").write_text("no archive")
    reader = spark.read.format("zipjsonl")
    zipjsonl.register(spark)
    if how == "other":
        # the tasks are other processes, so the root travels as a module beside the archives
        (tmp_path / "elsewhere_fs.py").write_text(f"from pyarrow import fs\n\ndef make():\n    return fs.SubTreeFileSystem({str(tmp_path)!r}, fs.LocalFileSystem())\n")
        monkeypatch.syspath_prepend(str(tmp_path))
        spark.sparkContext.addPyFile(str(tmp_path / "elsewhere_fs.py"))
        reader, path = reader.option("filesystem", "elsewhere_fs:make"), "in"
    else:
        path = str(folder) if how == "local" else f"file://{folder}"
    got = reader.load(path).collect()
    assert sorted(r.id for r in got) == sorted(f"u{1000 * n + i}" for n in range(3) for i in range(40))
    by = {}
    for r in got:
        by.setdefault(r.archive, []).append((r.ingest_seq, int(r.id[1:])))
    assert all(v == sorted(v) and [i for _, i in sorted(v)] == sorted(i for _, i in v) for v in map(sorted, by.values()))
    some = reader.option("member", "conversations.json").load(f"{path}/b[12].zip").where("id in ('c1-3', 'c2-29', 'c0-1')")
    assert sorted((r.conversation_id, r.title) for r in tables.conversation_meta(some).collect()) == [("c1-3", "t3"), ("c2-29", "t29")]
    one = reader.option("member", "utterances.jsonl").load(f"{path}/b1.zip").where("id = 'u1007'").collect()
    assert [json.loads(r.value)["text"] for r in one] == ["é" * (1007 % 7)]


@pytest.mark.parametrize("how, shares", [(zipfile.ZIP_STORED, 5), (zipfile.ZIP_DEFLATED, 1)])
def test_stored_members_are_split_at_lines(spark, tmp_path, how, shares):
    lines = [utterance(i) + "\n" for i in range(200)]
    lines[-1] = lines[-1].rstrip("\n")
    make(tmp_path, "a.zip", lines, {}, how)
    size = sum(len(x.encode()) for x in lines)
    for split in (size // 5 + 1, 50, 1000):
        planned = zipjsonl.planned(str(tmp_path), "utterances.jsonl", None, split, 1)
        assert len(planned) >= shares if how == zipfile.ZIP_STORED else len(planned) == 1
    zipjsonl.register(spark)
    for split in (size // 5 + 1, 333, 64):
        got = spark.read.format("zipjsonl").option("splitBytes", split).option("packBytes", 500).load(str(tmp_path)).collect()
        assert [r.id for r in sorted(got, key=lambda r: r.ingest_seq)] == [f"u{i}" for i in range(200)]


def test_small_archives_share_a_task(tmp_path):
    for n in range(20):
        make(tmp_path, f"a{n:02d}.zip", [utterance(n) + "\n"], {})
    assert len(zipjsonl.planned(str(tmp_path), "utterances.jsonl")) == 1
    assert len(zipjsonl.planned(str(tmp_path), "utterances.jsonl", pack=1)) == 20
    assert [len(s.pieces) for s in zipjsonl.planned(f"file://{tmp_path}/a0*.zip", "utterances.jsonl")] == [10]
    with pytest.raises(FileNotFoundError):
        zipjsonl.planned(str(tmp_path / "none"), "utterances.jsonl")
    with pytest.raises(FileNotFoundError):
        zipjsonl.planned(str(tmp_path), "nothing.jsonl")


def test_malformed_lines_are_errors(spark, tmp_path):
    make(tmp_path, "a.zip", ['{"id": "1"}\n', "{broken\n"], {})
    zipjsonl.register(spark)
    with pytest.raises(Exception, match="Expecting property name"):
        spark.read.format("zipjsonl").load(str(tmp_path)).collect()
