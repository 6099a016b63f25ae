"""Registered queries of the judging path, the archive path and the text functions around them.

The tables have no generations, judge answers or archives, so these are made of the rows of
``labels``, ``conversations`` and ``documents``, alike in Spark and in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.operators import archives, copyscan, judging, prompts, splits, threads
from palaver.plans.catalogue import _WS, query, table
from palaver.sources.tables import read_targets

_TARGETS = """t AS (SELECT doc_id % 5 AS user_id, doc_id AS target_no, 'p' || doc_id AS post_id, doc_id % 7 AS target_idx, 'truth ' || doc_id AS ground_truth,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'said ' || doc_id END AS own, unnest(range(0, 1 + doc_id % 3)) AS gen_no FROM labels),
g AS (SELECT *, 'g' || target_no || '-' || gen_no AS response, (target_no + gen_no) % 6 = 5 AS lost FROM t),
h AS (SELECT doc_id % 5 AS user_id, 'said ' || min(doc_id) AS first_history FROM labels WHERE doc_id % 4 <> 0 GROUP BY 1)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    made = F.transform(F.sequence(F.lit(0), n % 3), lambda i: F.struct(F.concat(F.lit("g"), n.cast("string"), F.lit("-"), i.cast("string")).alias("response")))
    return table(spark, sf_dir, "labels").select(
        (n % 5).alias("user_id"),
        n.alias("target_no"),
        F.concat(F.lit("p"), n.cast("string")).alias("post_id"),
        (n % 7).alias("target_idx"),
        F.concat(F.lit("truth "), n.cast("string")).alias("ground_truth"),
        F.lit("some words").alias("context"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("said "), n.cast("string"))).alias("user_history"),
        F.when(n % 3 == 0, F.slice(made, 1, 0)).otherwise(made).alias("generations"),
        F.concat(F.lit("g"), n.cast("string"), F.lit("-0")).alias("generated_response"),
    )


def _answers(raw):
    """A table of answers by job, one in six missing."""

    def answer(jobs: DataFrame) -> DataFrame:
        return jobs.withColumn("_n", F.col("target_no") + F.col("gen_no")).where("_n % 6 <> 5").select(*judging.JOB, raw(F.col("_n")).alias("raw"))

    return answer


@query(f"""WITH {_TARGETS},
b AS (SELECT *, position(right(sha256(user_id || '|' || post_id || '|' || target_idx || '|' || response), 1) IN '0123456789abcdef') % 2 = 1 AS is_b, 1 + (target_no + gen_no) % 9 AS rating FROM g),
s AS (SELECT *, CASE WHEN lost OR rating > 7 THEN 0 WHEN is_b THEN rating ELSE 8 - rating END AS score FROM b)
SELECT user_id, target_no, post_id, coalesce(nullif(own, ''), first_history) AS user_history, count(*)::INT AS n_generations,
  string_agg(score::VARCHAR, ',' ORDER BY gen_no) AS scores, string_agg(CASE WHEN lost OR rating > 7 THEN 1 ELSE 0 END::VARCHAR, ',' ORDER BY gen_no) AS failed, round(avg(score), 6) AS mean_score
FROM s JOIN h USING (user_id) GROUP BY ALL""")
def judge_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda n: F.concat(F.lit('{"rating": '), (1 + n % 9).cast("string"), F.lit("}"))
    got = judging.judge(_targets(spark, sf_dir), "pairwise", _answers(raw))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")
    return got.select(
        "user_id", "target_no", "post_id", "user_history", F.size("generations").alias("n_generations"), listed("score").alias("scores"), listed("parse_error").alias("failed"), F.round("mean_score", 6).alias("mean_score")
    )


@query(f"""WITH {_TARGETS}, s AS (SELECT *, CASE WHEN lost THEN 0 ELSE (target_no + gen_no) % 5 * 0.25 END AS c, CASE WHEN lost THEN 0 ELSE (target_no + gen_no) % 3 * 0.5 END AS e FROM g)
SELECT user_id, target_no, string_agg(response, ',' ORDER BY gen_no) AS generations, round(sum((c + e) / 2), 6)::DOUBLE AS overall, round(sum(c), 6)::DOUBLE AS context_specificity, count(*) FILTER (WHERE lost)::INT AS failed
FROM s GROUP BY ALL""")
def judge_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n, m, x: (n % m * F.lit(x)).cast("decimal(10,2)").cast("string")
    raw = lambda n: F.concat(
        F.lit('{"context_specificity": {"score": '), part(n, 5, 0.25), F.lit('}, "user_evidence_compatibility": {"score": '), part(n, 3, 0.5), F.lit("}}")
    )
    got = judging.judge(_targets(spark, sf_dir), "specificity", _answers(raw))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c)
    failed = F.size(F.filter("parse_error", lambda x: x)).alias("failed")
    return got.select("user_id", "target_no", F.array_join("generations", ",").alias("generations"), total("overall"), total("context_specificity"), failed)


@query(f"""WITH {_TARGETS}, s AS (SELECT *, CASE WHEN lost THEN 0 ELSE (target_no + gen_no) % 5 * 0.25 END AS c FROM g)
SELECT user_id, target_no, round(sum(c), 6)::DOUBLE AS score, count(*) FILTER (WHERE lost)::INT AS failed FROM s GROUP BY ALL""")
def judge_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda n: F.concat(F.lit('{"score": '), (n % 5 * F.lit(0.25)).cast("decimal(10,2)").cast("string"), F.lit(', "thought": "t"}'))
    got = judging.judge(_targets(spark, sf_dir), "similarity", _answers(raw))
    return got.select("user_id", "target_no", F.round(F.aggregate("score", F.lit(0.0), lambda a, x: a + x), 6).alias("score"), F.size(F.filter("parse_error", lambda x: x)).alias("failed"))


@query(f"""WITH {_TARGETS} SELECT user_id, target_no, gen_no::INT AS gen_no, response, sha256('## Earlier messages' || chr(10) || own || chr(10) || chr(10) || '## Conversation so far' || chr(10) || 'some words') AS shown_sha,
 sha256('## Candidate 1' || chr(10) || response || chr(10) || chr(10) || '## Candidate 2' || chr(10) || ground_truth) AS blocks_sha, '{{"1":"' || response || '","2":"' || ground_truth || '"}}' AS as_json FROM g""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judging.jobs(_targets(spark, sf_dir))
    both = F.array("response", "ground_truth")
    shown = judging.past_and_context("user_history", "context")
    return rows.select(
        *judging.JOB, "response", F.sha2(shown, 256).alias("shown_sha"), F.sha2(judging.numbered(both), 256).alias("blocks_sha"), judging.numbered_json(both).alias("as_json")
    )


@query("""WITH u AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1 ORDER BY 2, 1 LIMIT 3)
SELECT count(DISTINCT source) AS n_users, count(*) AS n_targets, sum(doc_id % 4)::BIGINT AS n_generations FROM documents JOIN u USING (source)""")
def eval_first_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), "doc_id", F.array_repeat(F.lit("g"), (F.col("doc_id") % 4).cast("int")).alias("generations"))
    return judging.generation_counts(judging.first_users(d, "user_id", "doc_id", 3))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE round(greatest(0, 0.9 * (doc_id % 4 * 0.25) + 0.1), 6) END::DOUBLE AS reward FROM labels""")
def group_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.concat(F.lit('{"score": '), (n % 4 * F.lit(0.25)).cast("decimal(10,2)").cast("string"), F.lit(', "thought": "t"}'))
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.floor(n / 4).alias("key"), F.floor(n / 4).cast("string").alias("ground_truth"), F.lit("c").alias("context"), raw.alias("raw"), F.lit(0.1).alias("bonus"), F.when(n % 5 == 0, " ").otherwise("r").alias("response")
    )
    return judging.group_rewards(rows, "key", ["ground_truth", "context"]).select("doc_id", F.round("reward", 6).alias("reward"))


@query("""WITH m AS (SELECT doc_id, quality::DOUBLE AS q, toxic::DOUBLE AS t FROM labels)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE q END AS quality, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE t END AS toxic FROM m""")
def metric_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda name, c: F.map_from_arrays(F.array(F.lit(name)), F.array(F.col(c).cast("double")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    m = F.map_concat(F.when(F.col("doc_id") % 3 != 0, pair("quality", "quality")).otherwise(none), F.when(F.col("doc_id") % 2 != 0, pair("toxic", "toxic")).otherwise(none))
    got = judging.union_keys(table(spark, sf_dir, "labels").select("doc_id", m.alias("m")), "m")
    return got.select("doc_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)).alias(k) for k in ("quality", "toxic")])


@query("""SELECT string_agg(source, ',' ORDER BY source) AS labels FROM (SELECT DISTINCT source FROM documents WHERE trim(source) <> '')""")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.labels(table(spark, sf_dir, "documents"), "source").select(F.array_join("labels", ",").alias("labels"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events), s AS (SELECT * FROM r WHERE r > 5),
u AS (SELECT user_id, row_number() OVER (ORDER BY min(r)) AS user_ord FROM s GROUP BY 1)
SELECT event_id, user_id, user_ord FROM s JOIN u USING (user_id) WHERE user_ord > 2 AND user_ord <= 42""")
def heldout_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("history").alias("conditioning_mode"))
    got = read_targets(e, "event_id", "user_id", offset=5, user_offset=2, users=40, modes={"conditioning_mode": "history"})
    return got.select("event_id", "user_id", "user_ord")


# archives: conversations told by several speakers, some in two archives
_RAW = """raw AS (SELECT CASE WHEN conv_id % 5 = 0 THEN turn % 2 ELSE 0 END AS archive_no, conv_id AS conv, turn AS seq, 'c' || conv_id AS conversation_id,
  CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'c' || conv_id ELSE 'c' || conv_id || '_' || turn END AS utterance_id,
  CASE WHEN turn = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'gone' ELSE '' END WHEN turn = 1 THEN 'c' || conv_id ELSE 'c' || conv_id || '_' || (turn - 1) END AS reply_to,
  CASE WHEN turn % 5 = 3 THEN 'AutoModerator' WHEN turn % 3 = 0 THEN 'op' || conv_id % 7 ELSE 'u' || turn % 3 END AS speaker,
  CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN '[deleted]' WHEN turn % 4 = 3 THEN '[removed]' ELSE 't ' || coalesce(text, '') || ' e' END AS body,
  (turn * 7) % 11 AS ts, CASE WHEN turn % 2 = 0 THEN '' ELSE 'ch' || conv_id % 3 END AS own FROM conversations),
meta AS (SELECT DISTINCT conv, CASE WHEN conv % 2 = 0 THEN 'm1' ELSE '' END AS channel, CASE WHEN conv % 6 = 0 THEN '' ELSE 'T' || conv END AS title FROM raw),
rooted AS (SELECT raw.*, title, reply_to = '' OR utterance_id = conversation_id AS is_root,
  CASE WHEN NOT (reply_to = '' OR utterance_id = conversation_id) THEN '' WHEN body = '[deleted]' THEN title WHEN title = '' THEN body ELSE title || chr(10) || chr(10) || body END AS op_text
  FROM raw JOIN meta USING (conv)),
flagged AS (SELECT *, speaker = 'AutoModerator' AND NOT (is_root AND op_text <> '') AS bad_speaker, body IN ('[deleted]', '[removed]') AND NOT (is_root AND op_text <> '') AS bad_text FROM rooted)"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    conv, turn = F.col("conv_id"), F.col("turn")
    text_ = lambda c: c.cast("string")
    thread = F.concat(F.lit("c"), text_(conv))
    rows = table(spark, sf_dir, "conversations").select(
        F.when(conv % 5 == 0, turn % 2).otherwise(0).cast("int").alias("archive_no"),
        F.when((turn == 0) & (conv % 2 == 0), thread).otherwise(F.concat(thread, F.lit("_"), text_(turn))).alias("utterance_id"),
        thread.alias("conversation_id"),
        F.when((turn == 0) & (conv % 2 == 0), "gone").when(turn == 0, "").when(turn == 1, thread).otherwise(F.concat(thread, F.lit("_"), text_(turn - 1))).alias("reply_to"),
        F.when(turn % 5 == 3, "AutoModerator").when(turn % 3 == 0, F.concat(F.lit("op"), text_(conv % 7))).otherwise(F.concat(F.lit("u"), text_(turn % 3))).alias("speaker"),
        F.when((turn == 0) & (conv % 3 == 0), "[deleted]").when(turn % 4 == 3, "[removed]").otherwise(F.concat(F.lit("t "), F.coalesce("text", F.lit("")), F.lit(" e"))).alias("text"),
        (turn * 7 % 11).cast("double").alias("ts"),
        turn.cast("long").alias("seq"),
        F.when(turn % 2 == 0, "").otherwise(F.concat(F.lit("ch"), text_(conv % 3))).alias("channel"),
        F.lit("").alias("title"),
    )
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("archive_no"))
    meta = c.select(
        "archive_no",
        F.concat(F.lit("c"), text_(conv)).alias("conversation_id"),
        F.when(conv % 2 == 0, F.concat(F.lit("m"), text_(F.col("archive_no")))).otherwise("").alias("channel"),
        F.when((conv % 6 != 0) & (F.col("archive_no") == 0), F.concat(F.lit("T"), text_(conv))).otherwise("").alias("title"),
    )
    return rows, archives.merge_metadata(meta)


def _rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, meta = _raw(spark, sf_dir)
    return archives.with_root(archives.with_channel(rows, meta, default="d"))


@query(f"""WITH {_RAW} SELECT utterance_id, coalesce(nullif(own, ''), nullif(channel, ''), 'd') AS archive, coalesce(nullif(own, ''), nullif(channel, ''), 'first', 'd') AS second_pass,
 coalesce(nullif(channel, ''), nullif(own, ''), 'd') AS corpus, coalesce(nullif(own, ''), nullif(channel, ''), '') AS single, title FROM raw JOIN meta USING (conv)""")
def archive_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, meta = _raw(spark, sf_dir)
    earlier = meta.select("conversation_id", F.lit("first").alias("channel"))
    out = rows.select("utterance_id")
    for entry in archives.PRECEDENCE:
        got = archives.with_channel(rows, meta, entry, "d", earlier).select("utterance_id", F.col("channel").alias(entry), *(["title"] if entry == "single" else []))
        out = out.join(got, "utterance_id")
    return out


@query(f"WITH {_RAW} SELECT utterance_id, is_root, bad_speaker, bad_text, op_text FROM flagged")
def archive_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rooted(spark, sf_dir).select("utterance_id", "is_root", "bad_speaker", "bad_text", "op_text")


@query(f"""WITH {_RAW}, a AS (SELECT speaker AS user_id, conversation_id, min(ts)::DOUBLE AS first_at FROM flagged WHERE NOT is_root AND NOT bad_speaker AND NOT bad_text GROUP BY 1, 2)
SELECT a.*, NOT EXISTS (SELECT 1 FROM flagged r WHERE r.is_root AND NOT r.bad_speaker AND NOT r.bad_text AND r.conversation_id = a.conversation_id AND r.speaker = a.user_id) AS of_others FROM a""")
def archive_first_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted = _rooted(spark, sf_dir)
    others = archives.first_activity(rooted, without_opener=True).select("user_id", "conversation_id", F.lit(True).alias("of_others"))
    got = archives.first_activity(rooted).join(others, ["user_id", "conversation_id"], "left")
    return got.withColumn("of_others", F.coalesce("of_others", F.lit(False)))


_RECORDS = f"""{_RAW}, chan AS (SELECT *, coalesce(nullif(own, ''), (SELECT nullif(m.channel, '') FROM meta m WHERE m.conv = flagged.conv), 'd') AS channel FROM flagged),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY archive_no, seq) AS place FROM chan),
rec AS (SELECT conversation_id, arg_min(channel, place) AS channel, min(title) AS title,
  coalesce(min(utterance_id) FILTER (WHERE is_root AND NOT bad_speaker AND NOT bad_text), '') AS root_id, coalesce(min(speaker) FILTER (WHERE is_root AND NOT bad_speaker AND NOT bad_text), '') AS root_speaker,
  coalesce(min(op_text) FILTER (WHERE is_root AND NOT bad_speaker AND NOT bad_text), '') AS op_text, bool_or(is_root AND (bad_speaker OR bad_text)) AS unusable_root FROM ordered GROUP BY 1)"""


@query(f"WITH {_RECORDS} SELECT * FROM rec")
def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.merge_records(archives.thread_records(_rooted(spark, sf_dir)))


_THREADS = f"""{_RECORDS}, said AS (SELECT f.conversation_id AS post_id, utterance_id AS comment_id, CASE WHEN reply_to = f.conversation_id THEN '' ELSE reply_to END AS parent_id, speaker, body,
  bad_speaker OR bad_text AS context_only, root_speaker, row_number() OVER (PARTITION BY f.conversation_id ORDER BY ts, utterance_id, seq) - 1 AS idx FROM flagged f JOIN rec USING (conversation_id) WHERE NOT is_root),
thr AS (SELECT 'u1' AS target_user, post_id, idx, comment_id, parent_id, CASE WHEN context_only THEN '' ELSE speaker END AS user_id, body AS text,
  CASE WHEN context_only THEN CASE WHEN body = '[removed]' THEN 'OTHER - REMOVED' ELSE 'OTHER - AUTOMOD' END WHEN speaker <> 'u1' AND speaker = root_speaker THEN 'OTHER - OP' ELSE '' END AS label,
  NOT context_only AND speaker = 'u1' AS is_target FROM said)"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted = _rooted(spark, sf_dir)
    records = archives.merge_records(archives.thread_records(rooted))
    targets = records.select(F.lit("u1").alias("target_user"), "conversation_id")
    return archives.assembled(rooted, records, targets)


@query(f"WITH {_THREADS} SELECT target_user, post_id, idx::INT AS idx, comment_id, parent_id, user_id, text, label, is_target FROM thr")
def archive_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)


def _named_sql(values: str, kind: str) -> str:
    return f"SELECT v, 'corpus_{kind}_' || lpad((row_number() OVER (ORDER BY v) - 1)::VARCHAR, 6, '0') AS a FROM (SELECT DISTINCT unnest([{values}]) AS v FROM thr) WHERE trim(v) <> ''"


@query(f"""WITH {_THREADS}, us AS ({_named_sql("target_user, user_id", "user")}), ps AS ({_named_sql("post_id", "thread")}), cs AS ({_named_sql("comment_id, parent_id", "comment")})
SELECT t.a AS target_user, p.a AS post_id, idx::INT AS idx, coalesce(c.a, '') AS comment_id, coalesce(q.a, '') AS parent_id, CASE WHEN label = 'OTHER - OP' THEN '' ELSE coalesce(u.a, user_id) END AS user_id
FROM thr JOIN us t ON t.v = target_user JOIN ps p ON p.v = post_id LEFT JOIN cs c ON c.v = comment_id LEFT JOIN cs q ON q.v = parent_id LEFT JOIN us u ON u.v = user_id""")
def archive_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.anonymised(_assembled(spark, sf_dir)).select("target_user", "post_id", "idx", "comment_id", "parent_id", "user_id")


@query(f"""WITH {_THREADS} SELECT post_id, any_value(op_text) AS op_text, count(*) AS n_comments FROM thr JOIN rec ON conversation_id = post_id WHERE trim(op_text) <> '' AND NOT unusable_root
AND post_id IN (SELECT post_id FROM thr WHERE is_target) GROUP BY 1""")
def archive_usable_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted = _rooted(spark, sf_dir)
    records = archives.merge_records(archives.thread_records(rooted)).withColumnRenamed("conversation_id", "post_id")
    comments = _assembled(spark, sf_dir)
    got = threads.usable_threads(comments, records)
    return splits.only(got, comments.where("is_target"), "post_id").select("post_id", "op_text", "n_comments")


@query(f"""WITH {_RAW}, f AS (SELECT conversation_id AS post_id, archive_no, is_root, CASE WHEN is_root THEN op_text ELSE 'T' || conv END AS op_text FROM flagged WHERE is_root OR seq = 1),
b AS (SELECT post_id, arg_min(op_text, CASE WHEN is_root THEN 0 ELSE 10 END + archive_no) AS op_text FROM f WHERE trim(op_text) <> '' GROUP BY 1)
SELECT w.post_id, op_text FROM (SELECT DISTINCT conversation_id AS post_id FROM raw) w LEFT JOIN b USING (post_id)""")
def archive_recovered_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted = _rooted(spark, sf_dir)
    named = F.concat(F.lit("T"), F.substring("conversation_id", 2, 99))
    found = rooted.where("is_root or seq = 1").select(
        F.col("conversation_id").alias("post_id"), F.col("archive_no").alias("archive_ord"), "is_root", F.when(F.col("is_root"), F.col("op_text")).otherwise(named).alias("op_text")
    )
    return threads.recover_openings(rooted.select(F.col("conversation_id").alias("post_id")).distinct(), found)


@query(f"""WITH {_RAW}, shown AS (SELECT conversation_id AS post_id, seq // 3 AS chain_no, seq % 3 AS depth, utterance_id AS comment_id, speaker || ': ' || body AS line, conv % 2 = 0 AS open_root FROM raw),
blocks AS (SELECT post_id, chain_no, CASE WHEN bool_or(depth = 0 AND open_root) THEN '[... earlier comments by other users ...]' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY depth) AS body FROM shown GROUP BY 1, 2)
SELECT post_id, string_agg(body, chr(10) || chr(10) ORDER BY chain_no) AS rendered FROM blocks GROUP BY 1""")
def archive_rendered_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _raw(spark, sf_dir)
    even = F.substring("conversation_id", 2, 99).cast("long") % 2 == 0
    line = F.concat("speaker", F.lit(": "), "text")
    shown = rows.select(
        F.col("conversation_id").alias("post_id"), F.floor(F.col("seq") / 3).alias("chain_no"), (F.col("seq") % 3).alias("depth"), F.col("utterance_id").alias("comment_id"), line.alias("line"), even.alias("open_root")
    )
    twice = shown.unionByName(shown.withColumn("chain_no", F.col("chain_no") + 100))  # met again: shown once
    return threads.render_chains(twice)


@query("""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN 'a' || doc_id || chr(10) || 'b' WHEN 1 THEN ' c' || doc_id WHEN 2 THEN 'd' ELSE 'words ' || text END) AS text_sha FROM documents""")
def chat_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    made = (
        F.when(kind == 0, F.concat(F.lit('[{"text": " a'), n, F.lit(' "}, "b", "", {"content": " "}]')))
        .when(kind == 1, F.concat(F.lit('{"text": " c'), n, F.lit('"}')))
        .when(kind == 2, F.lit('{"content": "d"}'))
        .otherwise(F.concat(F.lit("words "), "text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.chat_text(made), 256).alias("text_sha"))


@query(rf"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS p FROM documents)
SELECT doc_id, CASE WHEN length(p) <= 220 THEN p ELSE rtrim(substr(p, 1, 217)) || '...' END AS short, CASE WHEN length(p) <= 1000 THEN p ELSE substr(p, 1, 1000) || '...' END AS long FROM n""")
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt("text").alias("short"), text.excerpt("text", 1000, inside=False).alias("long"))


_BODY = "coalesce(text, '')"


@query(f"""SELECT doc_id, sha256('values: v ' || {_BODY} || ' e' || chr(10) || 'background: b') AS wrapped_sha, sha256('name: n ' || {_BODY} || ' e') AS scalar_sha,
 sha256('plain ' || {_BODY} || ' e') AS plain_sha FROM documents""")
def persona_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personas as a model may give them, with whole texts inside: wrapped objects, an object with one text, plain text."""
    told = lambda head: F.concat(F.lit(head), F.coalesce("text", F.lit("")), F.lit(" e"))
    summary = F.struct(F.concat(F.lit(" "), told("v ")).alias("values"), F.lit("b").alias("background"), F.lit(1).alias("other"))
    wrapped = F.to_json(F.struct(F.struct(summary.alias("summary")).alias("persona")))
    scalar = F.to_json(F.struct(told("n ").alias("name"), F.array(F.lit(1)).alias("list")))
    rows = table(spark, sf_dir, "documents").select("doc_id", wrapped.alias("w"), scalar.alias("s"), told("plain ").alias("p"))
    return rows.select("doc_id", *[F.sha2(prompts.persona_text(c), 256).alias(name) for c, name in (("w", "wrapped_sha"), ("s", "scalar_sha"), ("p", "plain_sha"))])


def _reconditioned_sql() -> str:
    line = "chr(10)"
    said = "'[CURRENT CONTEXT]' || chr(10) || 'now ' || coalesce(text, '') || ' end'"
    past = "'[USER HISTORY]' || chr(10) || 'old ' || coalesce(text, '') || ' end' || chr(10) || chr(10) || "
    who = "'[USER PERSONA]' || chr(10) || 'calm ' || coalesce(source, '') || ' one' || chr(10) || chr(10) || "
    parts = []
    for mode, system, user in (("history", "", past), ("persona", who, ""), ("history_persona", who, past)):
        prompt = f"'<|im_start|>system' || {line} || {system}'TASK<|im_end|>' || {line} || '<|im_start|>user' || {line} || {user}{said} || '<|im_end|>' || {line} || '<|im_start|>assistant' || {line}"
        parts.append(f"SELECT doc_id, '{mode}' AS conditioning_mode, sha256({prompt}) AS prompt_sha, 'truth ' || doc_id AS ground_truth FROM documents")
    return " UNION ALL ".join(parts)


@query(_reconditioned_sql())
def reconditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three modes over whole texts as history and context."""
    whole = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("old "), whole, F.lit(" end")).alias("user_history"),
        F.concat(F.lit("now "), whole, F.lit(" end \n[HUMAN]: ")).alias("context"),
        F.concat(F.lit(" calm "), F.coalesce("source", F.lit("")), F.lit(" one ")).alias("persona"),
        F.concat(F.lit(" truth "), F.col("doc_id").cast("string"), F.lit(" ")).alias("ground_truth"),
    )
    got = prompts.recondition(rows, prompts.MODES, "TASK")
    return got.select("doc_id", "conditioning_mode", F.sha2("prompt_text", 256).alias("prompt_sha"), "ground_truth")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) >= 40) AS m FROM documents)
SELECT doc_id, sha256(CASE WHEN len(m) = 0 THEN 'No copied passage was found.' ELSE array_to_string(list_transform(m, lambda x, i: i || '. ' || x), chr(10)) END) AS listed_sha FROM l""")
def copy_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer lines of each text stand in for the passages found."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.char_length(x) >= 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(copyscan.watchlist(lines), 256).alias("listed_sha"))


@query(r"""SELECT doc_id, doc_id % 3 = 0 AND len(regexp_extract_all('Here are some steps you can take. ' || replace(coalesce(text, ''), '?', '.'), '[\p{L}\p{N}\p{M}_'']+')) >= 24 AS assistant FROM documents""")
def assistant_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as answers; the truth is a short question, no question, or a question as long as the answer."""
    n, body = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    truth = F.when(n == 0, F.lit("Why is that?")).when(n == 1, F.lit("It was fine.")).otherwise(F.concat(F.lit("Why "), body, F.lit("?")))
    made = F.concat(F.lit("Here are some steps you can take. "), F.replace(body, F.lit("?"), F.lit(".")))
    return table(spark, sf_dir, "documents").select("doc_id", text.assistant_like(truth, made).alias("assistant"))
