import html
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from palaver.functions import scoring, text
from palaver.operators import copyscan, prompts, splits, threads, turns
from palaver.plans import evaluation
from palaver.sources import tables, zipjsonl
from palaver.streaming import groups


def col(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, x string").select("i", f("x").alias("y")).collect()
    return [r.y for r in sorted(out)]


def test_space_and_words(spark):
    values = [None, "", "  ", "a b", " a  b c", "x\x1cy z", "it's ß's"]
    assert col(spark, values, text.normalise_space) == [" ".join((v or "").split()) for v in values]
    assert col(spark, values, text.word_count) == [0, 0, 0, 2, 3, 3, 2]
    assert col(spark, ["one two  three", "one"], lambda c: text.last_words(c, 2)) == ["two three", "one"]
    assert col(spark, ["one two  three", "a  b"], lambda c: text.first_words(c, 2, "...")) == ["one two...", "a  b"]


def test_entities_and_quotes(spark):
    values = ["a &amp;amp;gt; b", r"\&gt; q", "&eacute;&#39;", None, "plain"]
    want = []
    for v in values:
        v = (v or "").replace("\\&gt;", "&gt;")
        for _ in range(3):
            v = html.unescape(v)
        want.append(v)
    assert col(spark, values, text.unescape_entities) == want
    got = col(spark, ["  [HUMAN]: hi", "[OTHER - OP]: > &gt; said", "> > x\n y\n", "[HUMAN]: >", None], text.strip_quotes)
    assert got == ["[HUMAN]: hi", "[OTHER - OP]: said", "x\n y", "[HUMAN]:", ""]


def test_redaction(spark):
    values = ["see u/someone and x/u/other /u/a-b_c! t1_abcde t9_abcde", "https://redd.it/abc, https://i.reddit.com/p", None]
    assert col(spark, values, text.redact) == [
        "see [REDDIT USER] and x/u/other [REDDIT USER]! [REDDIT ID] t9_abcde",
        "[REDDIT THREAD] [REDDIT LINK]",
        "",
    ]


def test_question_and_assistant(spark):
    assert col(spark, ["[HUMAN]: why me", "well", "really?", None], text.question_like) == [True, False, True, False]
    long = "Overall it is a fine thing " + "word " * 30
    d = spark.createDataFrame([("why so", long), ("no", long)], "t string, c string")
    assert [r.y for r in d.select(text.assistant_like("t", "c").alias("y")).collect()] == [True, False]


def test_chat_text_and_persona(spark):
    assert col(spark, [None, "hi", '[{"text": "a "}, "b", ""]', '{"content": "c"}'], text.chat_text) == ["", "hi", "a\nb", "c"]
    got = col(spark, ['{"persona": {"values": "v", "other_personal_cues": "b"}}', '{"x": "1", "y": ""}', "free text", None], prompts.persona_text)
    assert got == ["values: v\nbackground: b", "x: 1", "free text", ""]
    full = json.dumps({k: "t" for k in prompts.PERSONA_FIELDS})
    assert col(spark, [full, "```json\n" + full + "\n```", '{"values": "v"}', None], prompts.persona_valid) == [True, True, False, False]


def test_judgements(spark):
    sides = {f"{c}_{s}": 1.0 if s == "a" else 0.5 for s in "ab" for c in scoring.CRITERIA}
    cut = dict(sides, source_copy_penalty_a=2)
    values = [json.dumps(sides), json.dumps(cut), "```json\n" + json.dumps({"rating": 6.7}) + "\n```", '{"rating": "9"}', 'rating: 5 {', "nothing", '{"human_goal_score_a": 1}', None]
    got = col(spark, values, scoring.pairwise)
    assert [(r.score_a, r.score_b, r.rating, r.parse_error) for r in got] == [
        (3.0, 1.5, 2, False), (2.25, 1.5, 3, False), (0.0, 0.0, 6, False), (0.0, 0.0, None, True),
        (0.0, 0.0, 5, True), (0.0, 0.0, None, True), (0.0, 0.0, None, True), (0.0, 0.0, None, True),
    ]


def test_reasoning(spark):
    values = ["r1 [HUMAN]: a [human] : b", "x <response>y</response>", "x <response> y", "Human: z", "just text", "", "t </think> [HUMAN]: q", "a [HUMAN]:"]
    got = [(r.reasoning, r.response) for r in col(spark, values, scoring.reasoning_and_response)]
    assert got[:6] == [("r1 [HUMAN]: a", "b"), ("x", "y"), ("x", "y"), ("", "z"), ("", "just text"), ("", "")]
    assert got[6] == ("t", "q")


def test_tail_sizes(spark):
    d = spark.range(1, 60).select("id", splits.tail_size(F.col("id"), 0.3).alias("v"))
    for n, v in d.collect():
        want = int(n * 0.3)
        want = max(want, 1) if n > 1 else want
        assert v == max(0, min(want, n - 1))


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


def test_copy_runs(spark):
    rng = random.Random(1)
    rs = [[rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(12)]
    d = spark.createDataFrame([(i, i % 3, w) for i, w in enumerate(rs)], "doc long, g int, words array<string>")
    s = spark.createDataFrame([(i, i % 3, w) for i, w in enumerate(rs)], "item long, g int, words array<string>")
    got = copyscan.runs(d, s, ["doc", "g"], ["item"], ["g"], 3).collect()
    have = {}
    for r in got:
        have.setdefault((r.doc, r.item), set()).add((r.response_start, r.response_end, r.source_start, r.tokens))
    for i in range(12):
        for j in range(12):
            want = brute_runs(rs[i], rs[j], 3) if i % 3 == j % 3 else set()
            assert have.get((i, j), set()) == want


def test_chain_cycles_and_unknown_parents(spark):
    rows = [("p", "a", "b", 0), ("p", "b", "a", 1), ("p", "c", "zz", 2), ("p", "d", "c", 3), ("p", "d", None, 4), ("q", "a", None, 0)]
    got = threads.reply_chains(spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string, idx int")).collect()
    assert {(r.post_id, r.idx): r.chain for r in got} == {
        ("p", 0): ["b", "a"], ("p", 1): ["a", "b"], ("p", 2): ["c"], ("p", 3): ["c", "d"], ("p", 4): ["d"], ("q", 0): ["a"],
    }


def test_render_chains(spark):
    rows = [("p", 0, 0, "a", "A", True), ("p", 0, 1, "b", "B", True), ("p", 1, 0, "a", "A", True), ("p", 1, 1, "c", "C", True)]
    got = threads.render_chains(spark.createDataFrame(rows, "post_id string, chain_no int, depth int, comment_id string, line string, open_root boolean"))
    assert got.first().rendered == threads.EARLIER + "\nA\nB\n\nC"


def test_turn_choice(spark):
    rows = [
        (1, 0, 0, "user", "u", None, None, None), (1, 0, 1, "model", "x", False, 1.0, 1), (1, 0, 2, "model", "y", False, 2.0, 2), (1, 0, 3, "model", "z", False, 2.0, 1),
        (1, 1, 4, "model", "no user", True, 1.0, 1), (1, 2, 5, "user", "v", None, None, None), (1, 2, 6, "model", " ", True, 9.0, 0), (1, 2, 7, "model", "w", True, None, None),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn int, pos int, role string, content string, chosen boolean, score double, within int")
    got = {r.turn: (r.user_text, r.reply) for r in turns.selected_turns(d).collect()}
    assert got == {0: ("u", "z"), 2: ("v", "w")}


def test_zip_source(spark, tmp_path):
    lines = [{"id": "1", "root": "c", "speaker": {"id": "ann"}, "text": "hi", "timestamp": "7", "reply-to": None}, {"id": "2", "conversation_id": "c", "user": "bob", "text": None, "timestamp": "x"}]
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("in/utterances.jsonl", "\n\n".join(map(json.dumps, lines)))
        z.writestr("in/conversations.json", json.dumps({f"c{i}": {"meta": {"title": f"t{i}"}} for i in range(100)}))
    zipjsonl.register(spark)
    u = tables.utterances(spark.read.format("zipjsonl").load(str(tmp_path))).collect()
    assert [(r.comment_id, r.conversation_id, r.speaker, r.text, r.ts) for r in u] == [("1", "c", "ann", "hi", 7.0), ("2", "c", "bob", "", 0.0)]
    meta = spark.read.format("zipjsonl").option("member", "conversations.json").load(str(tmp_path)).where("id in ('c3', 'c77')")
    assert sorted(tables.conversation_meta(meta).collect()) == [("c3", "", "t3"), ("c77", "", "t77")]
    with pytest.raises(FileNotFoundError):
        zipjsonl.archives(str(tmp_path / "none"))


def test_sinks_and_personas(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a": "x", "b": {"values": "v"}}))
    assert {r.user_id: r.persona for r in tables.read_personas(spark, str(tmp_path / "p.json")).collect()} == {"a": "x", "b": '{"values":"v"}'}
    (tmp_path / "p.jsonl").write_text('{"user_id": "a", "persona": "1"}\n\n{"user_id": "a", "persona": "2"}\n')
    assert json.loads(tables.read_personas(spark, str(tmp_path / "p.jsonl")).first().persona)["persona"] == "2"
    rows = spark.createDataFrame([("grpo", "train", 1), ("grpo", "val", 2)], "role string, split string, x int")
    tables.write_roles(rows, str(tmp_path / "roles"))
    assert spark.read.parquet(str(tmp_path / "roles/role=grpo/split=val")).first().x == 2
    assert json.loads(tables.metadata(rows, ["role", "split"], seed=1)) == {"counts": {"grpo/train": 1, "grpo/val": 1}, "parameters": {"seed": 1}}
    assert tables.sibling("/d/x_train.parquet", "val") == "/d/x_val.parquet"


def test_prompt_modes(spark):
    d = spark.createDataFrame([("h", "c [HUMAN]: ", "p")], "user_history string, context string, persona string").withColumn("ground_truth", F.lit(" t "))
    r = prompts.recondition(d, "history_persona").first()
    assert r.prompt[0].content.startswith("[USER PERSONA]\np") and r.prompt[1].content == "[USER HISTORY]\nh\n\n[CURRENT CONTEXT]\nc"
    with pytest.raises(Exception, match="blank persona"):
        prompts.recondition(d.withColumn("persona", F.lit(" ")), "persona").collect()


def test_prompts_of_several_modes_from_one_reading(spark, tmp_path):
    d = [("[THREAD SOURCE]\npics\n\n old \u3000", "now [HUMAN]: \x85", " p "), ("[HISTORICAL CONTEXT] x", "[HUMAN]:", "p\xa0"), ("[USER HISTORY]", "", "q"), ("a\n[THREAD SOURCE] b", "c\x1f ", "r")]
    d = spark.createDataFrame(d, "user_history string, context string, persona string").withColumn("ground_truth", F.lit(" t\u2003"))
    want = [r for m in prompts.MODES for r in prompts.recondition(d, m).collect()]
    assert sorted(map(tuple, prompts.recondition(d, prompts.MODES).collect())) == sorted(map(tuple, want))
    assert sorted({r.prompt[1].content for r in want if r.conditioning_mode == "persona"}) == [f"[CURRENT CONTEXT]\n{x}" for x in ("", "", "c\x1f", "now")][1:]
    assert {r.prompt[1].content.partition("\n\n[CURRENT")[0] for r in want if r.conditioning_mode == "history"} == {
        "[USER HISTORY]\nold", "[USER HISTORY] x", "[USER HISTORY]", "[USER HISTORY]\na\n[THREAD SOURCE] b"
    }
    with pytest.raises(Exception, match="blank history"):
        prompts.recondition(d.withColumn("user_history", F.lit(" \x1c\u2029")), prompts.MODES).collect()
    spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = evaluation.reconditioned(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "regexp_replace" not in plan.replace("THREAD SOURCE", "", 1).partition("regexp_replace")[2]


def test_strips_what_the_patterns_strip(spark):
    ends = [chr(c) for c in range(1, 0x3100)] + ["\U0001f600", "", " \x85\u3000\x1c", "[HUMAN]:", "[HUMAN]: ", "[HUMAN]:\u2003", "[HUMAN]:[HUMAN]: ", "[HUMAN]:  x"]
    rows = spark.createDataFrame([(e,) for e in ends], "e string").select(F.concat("e", F.lit("a b"), "e").alias("t")).unionByName(spark.createDataFrame([(e,) for e in ends], "t string"))
    strip = F.regexp_replace("t", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    mark = F.rtrim(F.regexp_replace(F.regexp_replace("t", r"(?U)\s+\z", ""), r"\[HUMAN\]: ?\z", ""))
    assert rows.where((text.strip("t") != strip) | (text.strip_role_mark("t") != mark) | (text.blank("t") != (strip == ""))).count() == 0


def test_group_stream(spark, tmp_path):
    d = spark.createDataFrame([("x", str(i)) for i in range(9)] + [("y", "0")], "key string, payload string")
    d.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, payload string").json(str(tmp_path / "in"))
    q = groups.group_stream(stream, "key", n=4, timeout_ms=1000).writeStream.format("memory").queryName("grouped").outputMode("append").start()
    got = []
    for _ in range(60):  # time-outs keep the query busy, so it is polled
        q.awaitTermination(1)
        got = spark.table("grouped").collect()
        if len(got) >= 4:
            break
    q.stop()
    assert sorted((r.key, r.size, r.reason) for r in got) == [("x", 1, "timeout"), ("x", 4, "count"), ("x", 4, "count"), ("y", 1, "timeout")]


def test_retries(spark):
    rows = [(1, 1, True, True, "a"), (1, 2, True, False, "b"), (2, 1, False, False, None), (2, 2, True, True, "c"), (2, 3, True, True, "d")]
    d = spark.createDataFrame(rows, "k int, attempt int, parsed boolean, leaks boolean, answer string")
    assert sorted((r.k, r.answer, r.leaks) for r in groups.accept(d, "k").collect()) == [(1, "b", False), (2, "d", True)]
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k int")

    def attempt(missing, i):
        return missing.select("k", F.when(F.col("k") <= i + 1, F.concat(F.lit("r"), F.lit(i))).alias("answer"))

    got = groups.retry_rounds(wanted, "k", attempt, 3, lambda df: df.cache())
    assert sorted((r.k, r["round"]) for r in got.collect()) == [(1, 0), (2, 1), (3, 2)]
