"""Token windows and open metrics against plain loops."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import metrics, tokens

VOCABULARY = "/opt/tokenizers"
MESSAGES = "array<struct<role string, content string>>".replace(" string", ":string")


def pieces():
    """A hook that cuts words into pieces (made inside a function, for tasks can't import this file)."""

    def hook(texts):
        import re

        spans = [[m.span() for m in re.finditer(r"\s*\w{1,4}|\s*\W", t)] for t in texts]
        return [(list(range(len(s))), s) for s in spans]

    return hook


def byte_pairs():
    path = f"{VOCABULARY}/byte_bpe_50k.json"

    def hook(texts):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        return [(e.ids, e.offsets) for e in found]

    return hook


def one_token():
    return lambda texts: [([1], [(0, len(t))]) for t in texts]


def conversations(n):
    rng, out = random.Random(n), []
    words = ["hi", "naïve", "日本語", "don't", "x<|im_end|>y", "tab\tbed", "😀", "long" * 9]
    for i in range(n):
        said = [("user" if k % 2 == 0 else "assistant", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for k in range(2 * rng.randrange(1, 4))]
        out.append((i, said))
    return out


def plain_mask(said, hook):
    show = lambda m: "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in m)
    prefix, full = show(said[:-1]) + "<|im_start|>assistant\n", show(said)
    end = full.rfind("<|im_end|>")
    ids, spans = hook([full])[0]
    cut = lambda chars: next((k for k, (a, b) in enumerate(spans) if a >= chars or b > chars), len(spans))
    first, last = cut(len(prefix)), cut(end)
    return ids, [int(first <= k < last) for k in range(len(ids))]


@pytest.mark.parametrize("hook", [pieces, byte_pairs])
def test_masks_of_a_thousand_conversations(spark, hook):
    if hook is byte_pairs:
        pytest.importorskip("tokenizers")
    hook = hook()
    rows = conversations(1000)
    df = spark.createDataFrame(rows, f"id int, messages {MESSAGES}").repartition(3)
    got = {r.id: (r.input_ids, r.completion_mask) for r in tokens.learning_tokens(tokens.learning_texts(df, "messages"), hook).collect()}
    for i, said in rows:
        ids, mask = plain_mask(said, hook)
        assert got[i] == (list(ids), mask) and 1 in mask and mask[0] == 0


def test_hooks_get_bounded_texts(spark):
    most = tokens.TEXT_AT_ONCE

    def hook(texts):
        if len(texts) > 1 and sum(map(len, texts)) > most:
            raise ValueError(f"{len(texts)} texts at once")
        return [([len(t)], [(0, len(t))]) for t in texts]

    df = spark.range(6000, numPartitions=1).select("id", F.repeat(F.lit("ab "), F.when(F.col("id") == 7, most).otherwise(F.pmod("id", F.lit(300)).cast("int"))).alias("t"))
    got = tokens.tokenised(df.withColumn("n", F.char_length("t")), "t", hook, {"end": "n"}).select("id", "input_ids", "end").collect()
    assert sorted((r.id, r.input_ids, r.end) for r in got) == [(i, [3 * (most if i == 7 else i % 300)], int(i % 300 > 0)) for i in range(6000)]


def test_prefills_and_broken_conversations(spark):
    text = spark.createDataFrame([(f"p{x}",) for x in ["", *tokens.EMPTY_PREFILLS, "<think>a</think>"]], "t string")
    assert [r.x for r in text.select(tokens.without_prefill(F.col("t")).alias("x")).collect()] == ["p"] * 6 + ["p<think>a</think>"]
    for said, message in (([("user", "a")], "last message"), ([], "last message"), ([("user", "a"), ("assistant", "")], "empty")):
        df = spark.createDataFrame([(1, said)], f"id int, messages {MESSAGES}")
        with pytest.raises(Exception, match=message):
            tokens.learning_texts(df, "messages").collect()
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")])], f"id int, messages {MESSAGES}")
    with pytest.raises(Exception, match="does not begin"):
        tokens.learning_texts(df, "messages", prompt=F.lit("other")).collect()
    with pytest.raises(Exception, match="no token"):
        tokens.learning_tokens(tokens.learning_texts(df, "messages"), one_token()).collect()


@pytest.mark.parametrize("most", [None, 7, 3])
def test_padded_batches(spark, most):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.randrange(9) for _ in range(rng.randrange(8))], [rng.randrange(9) for _ in range(rng.randrange(1, 6))]) for i in range(40)]
    got = {r.id: r for r in tokens.padded(spark.createDataFrame(rows, "id int, b int, p array<int>, t array<int>"), ["b"], "p", "t", 99, most).collect()}
    cut = {}
    for i, b, p, t in rows:
        if most is not None:
            t = t[:most]
            room = most - len(t)
            p = p[-room:] if room else []
        cut[i] = (b, p, t)
    for i, (b, p, t) in cut.items():
        wp, wt = (max(len(v[k]) for v in cut.values() if v[0] == b) for k in (1, 2))
        left, right = wp - len(p), wt - len(t)
        mask = [0] * left + [1] * (len(p) + len(t)) + [0] * right
        r = got[i]
        assert r.input_ids == [99] * left + p + t + [99] * right and r.attention_mask == mask
        assert r.position_ids == np.maximum(np.cumsum(mask) - 1, 0).tolist()
        assert r.responses == t + [99] * right and r.response_mask == [1] * len(t) + [0] * right


# --- metrics


def plain_metrics(samples):
    """samples: the objects of one batch."""
    own = {k for s in samples for k in s if k != metrics.EXTRA}
    more = {k for s in samples for k in s.get(metrics.EXTRA) or {}}

    def numbers(objects, key):
        out = []
        for o in objects:
            try:
                out.append(float("nan") if o[key] is None else float(o[key]))
            except (KeyError, TypeError, ValueError):
                return None
        return np.array(out)

    def field(key):
        return numbers(samples, key) if key in own else numbers([s.get(metrics.EXTRA) or {} for s in samples], key)

    out = {}
    for name in {*metrics.NAMES, *(k for k in own | more if k.startswith(("format_", "length_")))}:
        values = next((v for k in metrics.ALIASES.get(name, [name]) if (v := field(k)) is not None), None)
        if values is None:
            continue
        mean = float(np.mean(values))
        out[f"reward/{name}/mean"] = mean
        if name in metrics.RATES:
            out[f"reward/{name}/rate"] = mean
        if name in metrics.OLDER_RATES:
            out[f"reward/{name}_rate/mean"] = mean
        if name in metrics.COPIES:
            out[metrics.COPIES[name]] = mean
    for key in own:
        if (m := re.match("^train/([^:]+):score$", key)) and (values := numbers(samples, key)) is not None:
            active = numbers(samples, f"train/active/{m[1]}") if f"train/active/{m[1]}" in own else None
            if active is not None:
                values = values[active > 0]
            if len(values):
                out[f"reward/train/{m[1]}/score/mean"] = float(np.mean(values))
    return out


def test_open_metrics_equal_a_plain_loop(spark):
    rng, rows = random.Random(5), []
    keys = ["score", "raw_reward", "format", "format_score", "format_bonus", "length_x", "source_copy", "meaningful_thinking", "other", "total_score", "train/a:score", "train/active/a", "train/b:score", "train/active/b", "train/:score"]
    value = lambda kind: rng.choice([[1, 0.5, -2, 3], [True, False], ["1.5", " 2 ", "-1e1"], [1, "word"], [0, None, 1], [{"x": 1}], [0, 0.0]][kind])
    for batch in range(60):
        kinds = {k: rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]) for k in keys}
        lacking = {k for k in keys if rng.random() < 0.3}
        sometimes = {k for k in keys if rng.random() < 0.15}
        for _ in range(rng.randrange(1, 6)):
            made = {k: value(kinds[k]) for k in keys if k not in lacking and not (k in sometimes and rng.random() < 0.5)}
            if batch % 2:
                made[metrics.EXTRA] = {k: value(kinds[k]) for k in keys[:10] if rng.random() < 0.9 or batch % 4 == 1} if batch % 5 else rng.choice([None, "x", {}])
            rows.append((batch if batch else None, json.dumps(made)))
    df = spark.createDataFrame(rows, "step int, info string").select("step", F.parse_json("info").alias("info"))
    got = {}
    for r in metrics.open_metrics(df, ["step"], "info").collect():
        assert r.metric not in got.setdefault(r.step, {})
        got[r.step][r.metric] = r.value
    by = {}
    for step, info in rows:
        made = json.loads(info)
        if not isinstance(made.get(metrics.EXTRA), dict):
            made.pop(metrics.EXTRA, None)
        by.setdefault(step, []).append(made)
    for step, samples in by.items():
        want = plain_metrics(samples)
        assert got.get(step, {}) == pytest.approx(want, nan_ok=True), step
    assert metrics.open_metrics(df.where("false"), ["step"], "info").count() == 0
