"""Registered queries over the test tables, with the DuckDB SQL that checks them.

Users are customers or event users, threads are orders or conversations, free text is
``documents``, copied sources are ``benchmark``. Judge output is made of ids alike on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import scoring, text
from palaver.operators import copyscan, metrics, prompts, splits, threads, tokens, turns
from palaver.sources import ordered
from palaver.streaming import groups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HASH = "((('0x' || substr(sha256({0}), 1, 8))::BIGINT % {1}) * (4294967296 % {1}) + ('0x' || substr(sha256({0}), 9, 8))::BIGINT % {1}) % {1}"


def _int_hash(name: str, width: int) -> str:
    return _HASH.format(name, width)


@query(f"""
WITH r AS (
  SELECT o_custkey AS user_id, o_orderkey AS post_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS thread_rank,
         count(*) OVER (PARTITION BY o_custkey) AS n, 2 + {_int_hash("'42:' || o_custkey::VARCHAR", 5)} AS k
  FROM orders
), v AS (SELECT *, greatest(0, least(greatest(floor((n - k)::DOUBLE * 0.1), 1), n - k - 1)) AS v FROM r WHERE n > k + 1)
SELECT user_id, post_id, thread_rank, k::BIGINT AS history_count,
       CASE WHEN thread_rank <= k THEN 'history' WHEN thread_rank <= n - v THEN 'train' ELSE 'val' END AS label FROM v
""")
def history_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("post_id"), "o_orderdate")
    got = splits.history_split(rows, "user_id", ["o_orderdate", "post_id"])
    return got.select("user_id", "post_id", "thread_rank", "history_count", "label")


@query("SELECT o_custkey AS user_id, count(DISTINCT o_orderkey) AS n_threads FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 8")
def eligible_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    return splits.eligible(rows, "user_id", "o_orderkey", 8)


@query("SELECT user_id, event_type, epoch_us(min(ts)) AS first_at FROM events GROUP BY 1, 2")
def first_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = splits.first_activity(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
    return got.withColumn("first_at", F.unix_micros(F.col("first_at").cast("timestamp")))


@query("""
WITH r AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_id, CASE WHEN r > n - greatest(0, least(greatest(floor(n::DOUBLE * 0.3), 1), n - 1)) THEN 'val' ELSE 'train' END AS split FROM r WHERE n > 1
""")
def user_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return splits.user_tail_split(rows, "user_id", ["ts", "event_id"], 0.3).select("user_id", "event_id", "split")


@query("""
WITH u AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('42:heldout:' || c_custkey::VARCHAR), c_custkey) AS user_rank, count(*) OVER () AS n FROM customer),
h AS (SELECT c_custkey, user_rank, user_rank <= round_even(n::DOUBLE * 0.4, 0) AS chosen FROM u)
SELECT h.c_custkey AS user_id, h.user_rank, h.chosen, count(o_orderkey) AS n_kept
FROM h LEFT JOIN orders ON o_custkey = h.c_custkey AND NOT h.chosen GROUP BY ALL
""")
def heldout_user_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splits.fraction_cut(table(spark, sf_dir, "customer"), "c_custkey", 0.4, "heldout")
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = splits.without(rows, cut.where("chosen"), "c_custkey").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_kept"))
    return cut.join(kept, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), "user_rank", "chosen", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("""
WITH m AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS m,
  row_number() OVER (PARTITION BY user_id ORDER BY sha256('42:conv:' || user_id::VARCHAR || ':' || event_id::VARCHAR), event_id) AS r FROM (SELECT DISTINCT user_id, event_id FROM events))
SELECT user_id, event_id, CASE WHEN r <= CASE WHEN m > 1 THEN least(greatest(1, floor(m * 0.3::DOUBLE)), m - 1) ELSE greatest(1, floor(m * 0.3::DOUBLE)) END THEN 'val' ELSE 'test' END AS split FROM m
""")
def heldout_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.heldout_conversations(table(spark, sf_dir, "events"), "user_id", "event_id", 0.3)


@query("""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '5%')
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (o_custkey)) AS n_both
""")
def role_overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return splits.overlap(rows.where("o_orderpriority like '1%'"), rows.where("o_orderpriority like '5%'"), "o_custkey")


@query("""
SELECT o_orderkey AS post_id, row_number() OVER (ORDER BY o_custkey, o_orderstatus, o_orderdate, o_orderkey) - 1 AS prompt_idx FROM orders
""")
def row_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    got = splits.number_rows(rows, "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])
    return got.select(F.col("o_orderkey").alias("post_id"), "prompt_idx")


@query("SELECT DISTINCT o_custkey AS user_id FROM orders ORDER BY 1 LIMIT 50 OFFSET 10")
def offset_limit_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.slice_users(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id"), "user_id", 10, 50)


@query("""
WITH u AS (SELECT DISTINCT c_name FROM customer), m AS (SELECT c_name, 'user_' || lpad((row_number() OVER (ORDER BY c_name) - 1)::VARCHAR, 6, '0') AS anonymous_id FROM u)
SELECT o_orderkey AS post_id, coalesce(anonymous_id, '') AS anonymous_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN m USING (c_name)
""")
def anonymise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer")
    ids = splits.sequential_ids(users, "c_name", "user")
    named = users.select("c_custkey", "c_name").join(ids, "c_name")
    got = table(spark, sf_dir, "orders").join(named, F.col("o_custkey") == F.col("c_custkey"), "left")
    return got.select(F.col("o_orderkey").alias("post_id"), F.coalesce("anonymous_id", F.lit("")).alias("anonymous_id"))


# a tree of comments: each turn answers the turn before, every third the first
_EDGES = "conv_id::VARCHAR AS post_id, 't' || turn AS comment_id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN 't0' ELSE 't' || (turn - 1) END AS parent_id, turn AS idx"


@query(f"""
WITH RECURSIVE e AS (SELECT {_EDGES} FROM conversations), w AS (
  SELECT post_id, comment_id, comment_id AS path, parent_id FROM e
  UNION ALL SELECT w.post_id, w.comment_id, e.comment_id || '>' || w.path, e.parent_id FROM w JOIN e ON e.post_id = w.post_id AND e.comment_id = w.parent_id
) SELECT post_id, comment_id, arg_max(path, length(path)) AS path FROM w GROUP BY 1, 2
""")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = threads.reply_chains(_edges(spark, sf_dir))
    return got.select("post_id", "comment_id", F.array_join("chain", ">").alias("path"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    parent = F.when(F.col("turn") == 0, None).when(F.col("turn") % 3 == 0, "t0").otherwise(F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("post_id"), F.concat(F.lit("t"), turn).alias("comment_id"), parent.alias("parent_id"), F.col("turn").cast("int").alias("idx")
    )


@query(f"""
WITH RECURSIVE e AS (SELECT {_EDGES} FROM conversations), l AS (SELECT post_id, arg_max(comment_id, idx) AS comment_id FROM e WHERE idx % 2 = 0 GROUP BY 1),
w AS (SELECT e.post_id, e.comment_id, e.parent_id, 0 AS up FROM e JOIN l USING (post_id, comment_id)
  UNION ALL SELECT w.post_id, e.comment_id, e.parent_id, up + 1 FROM w JOIN e ON e.post_id = w.post_id AND e.comment_id = w.parent_id)
SELECT post_id, comment_id, max(up) OVER (PARTITION BY post_id) - up AS new_idx FROM w
""")
def last_target_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return threads.last_target_chain(edges, edges.where("idx % 2 = 0").select("post_id", "idx"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scored dialogues: three messages share a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        F.floor(F.col("turn") / 3).cast("long").alias("turn"),
        F.col("turn").cast("long").alias("pos"),
        "role",
        F.col("text").alias("content"),
        (F.length("text") % 3 == 0).alias("chosen"),
        (F.length("text") % 5).cast("double").alias("score"),
        F.lit(1).alias("within"),
    )


_WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PATHS = rf"""
m AS (SELECT conv_id, turn // 3 AS turn, turn AS pos, role, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS content,
             length(text) % 3 = 0 AS chosen, (length(text) % 5)::DOUBLE AS score FROM conversations),
t AS (SELECT conv_id, turn, arg_max(content, pos) FILTER (role = 'user') AS user_text,
        arg_min(content, pos) FILTER (role <> 'user' AND chosen) AS picked,
        arg_max(content, score * 1000000 - pos) FILTER (role <> 'user') AS best
      FROM m WHERE content <> '' GROUP BY 1, 2),
p AS (SELECT conv_id, turn, user_text, coalesce(picked, best, '') AS reply FROM t WHERE user_text IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS target_idx,
        '[HUMAN]: ' || user_text || CASE WHEN trim(reply) <> '' THEN chr(10) || '[OTHER]: ' || reply ELSE '' END AS line FROM p)
"""


@query(f"WITH {_PATHS} SELECT conv_id, turn, sha256(user_text) AS user_sha, sha256(reply) AS reply_sha FROM p")
def selected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = turns.selected_turns(_messages(spark, sf_dir))
    return got.select("conv_id", "turn", F.sha2("user_text", 256).alias("user_sha"), F.sha2("reply", 256).alias("reply_sha"))


@query(f"""WITH {_PATHS}
SELECT a.conv_id, a.target_idx, sha256(a.user_text) AS truth_sha, sha256(string_agg(b.line, chr(10) ORDER BY b.target_idx)) AS context_sha
FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.target_idx < a.target_idx GROUP BY a.conv_id, a.target_idx, a.user_text""")
def target_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.target_rows(turns.with_position(turns.selected_turns(_messages(spark, sf_dir))))
    return rows.select("conv_id", "target_idx", F.sha2("ground_truth", 256).alias("truth_sha"), F.sha2("context", 256).alias("context_sha"))


@query(f"WITH {_PATHS} SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY target_idx)) AS rendered_sha FROM n GROUP BY 1")
def conversation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.with_position(turns.selected_turns(_messages(spark, sf_dir)))
    return rows.select("conv_id", F.sha2(turns.render_messages(F.col("turns")), 256).alias("rendered_sha"))


@query(f"""WITH {_PATHS}, c AS (SELECT conv_id, conv_id % 7 AS user_id, string_agg(line, chr(10) ORDER BY target_idx) AS body FROM n GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conv_id) AS i FROM c)
SELECT user_id, sha256(string_agg('<Conversation ' || i || '>' || chr(10) || body || chr(10) || '</Conversation ' || i || '>', chr(10) || chr(10) ORDER BY i)) AS history_sha FROM k GROUP BY 1""")
def history_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.with_position(turns.selected_turns(_messages(spark, sf_dir))).withColumn("user_id", F.col("conv_id") % 7)
    return turns.numbered_history(rows, "user_id", "conv_id").select("user_id", F.sha2("history", 256).alias("history_sha"))


_SPLIT = rf"regexp_split_to_array(trim(regexp_replace(text, '{_WS}', ' ', 'g')), ' ')"


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS normal_sha,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_'']+'))::BIGINT AS n_words,
  sha256(CASE WHEN len({_SPLIT}) <= 10 THEN text ELSE array_to_string({_SPLIT}[:10], ' ') || '...' END) AS first_sha,
  sha256(CASE WHEN len({_SPLIT}) <= 10 THEN text ELSE array_to_string({_SPLIT}[-10:], ' ') END) AS last_sha FROM documents""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(text.normalise_space("text"), 256).alias("normal_sha"),
        text.word_count("text").cast("long").alias("n_words"),
        F.sha2(text.first_words("text", 10, "..."), 256).alias("first_sha"),
        F.sha2(text.last_words("text", 10), 256).alias("last_sha"),
    )


_LINKED = "'see https://www.reddit.com/r/pics/comments/ab' || doc_id || '/x and https://redd.it/z' || doc_id || ' by /u/user_' || doc_id || ' or https://old.reddit.com/user/u' || doc_id || ' (https://i.reddit.com/q) t1_abc' || doc_id || 'xyz '"


@query(rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({_LINKED} || text, ' ' || chr(9) || chr(10) || chr(13)),
 'https?://((www|old|np)\.)?reddit\.com/r/[A-Za-z0-9_]+/comments/[A-Za-z0-9]+[^\s<>()\]]*', '[REDDIT THREAD]', 'gi'),
 'https?://(www\.)?redd\.it/[A-Za-z0-9]+[^\s<>()\]]*', '[REDDIT THREAD]', 'gi'),
 'https?://((www|old|np)\.)?reddit\.com/(user|u)/[A-Za-z0-9_-]+/?[^\s<>()\]]*', '[REDDIT USER]', 'gi'),
 'https?://[^\s<>()\]]*(reddit\.com|redd\.it)[^\s<>()\]]*', '[REDDIT LINK]', 'gi'),
 '(^|[^\p{{L}}\p{{N}}_/])/?u/[A-Za-z0-9_-]{{3,20}}\b', '\1[REDDIT USER]', 'gi'),
 '\bt[1-6]_[a-z0-9]{{5,}}\b', '[REDDIT ID]', 'gi')) AS redacted_sha FROM documents""")
def redact_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    made = F.concat(
        F.lit("see https://www.reddit.com/r/pics/comments/ab"), n, F.lit("/x and https://redd.it/z"), n, F.lit(" by /u/user_"), n,
        F.lit(" or https://old.reddit.com/user/u"), n, F.lit(" (https://i.reddit.com/q) t1_abc"), n, F.lit("xyz "), "text",
    )
    return d.select("doc_id", F.sha2(text.redact(made), 256).alias("redacted_sha"))


@query("""SELECT doc_id, sha256(regexp_replace(chr(1) || text || chr(11) || 'x', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS clean_sha FROM documents""")
def sanitize_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("\x01"), "text", F.lit("\x0bx"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.sanitise(made), 256).alias("clean_sha"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS line,
  generate_subscripts(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), 1) AS i FROM documents),
q AS (SELECT doc_id, i, regexp_replace(CASE WHEN i % 3 = 1 THEN '> &gt; ' || line WHEN i % 3 = 2 THEN '  [HUMAN]: >' || line ELSE line END, '^[ \\t]+(\\[HUMAN\\]:)', '\\1') AS line FROM l)
SELECT doc_id, sha256(string_agg(regexp_replace(CASE WHEN line LIKE '[HUMAN]: >%' THEN trim('[HUMAN]: ' || regexp_replace(substr(line, 10), '^\\s*((&gt;|>)\\s*)+', '')) ELSE line END, '^((&gt;|>)\\s*)+', ''), chr(10) ORDER BY i)) AS plain_sha FROM q GROUP BY 1""")
def strip_quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.regexp_replace("text", "\n\\z", ""), "\n", -1)
    made = F.transform(
        lines,
        lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("> &gt; "), x)).when(i % 3 == 1, F.concat(F.lit("  [HUMAN]: >"), x)).otherwise(x),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_quotes(F.array_join(made, "\n")), 256).alias("plain_sha"))


def _unescaped_sql() -> str:
    """The entities that occur in the pages, three times; & itself comes last in each turn."""
    out = "html"
    for _ in range(3):
        for name, value in (("copy", "chr(169)"), ("middot", "chr(183)"), ("quot", "chr(34)"), ("amp", "'&'")):
            out = f"regexp_replace({out}, '&{name};?', {value}, 'g')"
    return f"SELECT page_id, sha256(coalesce({out}, '')) AS plain_sha FROM pages"


@query(_unescaped_sql())
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.unescape_entities("html"), 256).alias("plain_sha"))


_SPEAKERS = "['Ann', '[deleted]', ' None ', 'AutoModerator', 'fix_BOT', 'abbot', 'null']"
_TEXTS = "['[removed]', ' Deleted', 'none', 'hello', '', 'fine words', '[deleted]', 'ok', 'NULL']"
_CASES = f"SELECT event_id, {_SPEAKERS}[1 + event_id % 7] AS speaker, {_TEXTS}[1 + event_id % 9] AS body FROM events"


@query(f"""WITH e AS ({_CASES}), f AS (SELECT *, lower(trim(speaker)) AS s, lower(trim(body)) AS b FROM e)
SELECT event_id, s IN ('', '[deleted]', 'deleted', 'none', 'null', 'automoderator') OR s LIKE '%bot' AS bad_speaker,
  b IN ('', '[deleted]', '[removed]', 'deleted', 'removed', 'none', 'null') AS bad_text,
  CASE WHEN b IN ('[deleted]', 'deleted') THEN 'OTHER - DELETED' WHEN b IN ('[removed]', 'removed') THEN 'OTHER - REMOVED' WHEN s = 'automoderator' THEN 'OTHER - AUTOMOD'
    WHEN s LIKE '%bot' THEN 'OTHER - BOT' WHEN s IN ('', '[deleted]', 'deleted', 'none', 'null') THEN 'OTHER - DELETED USER' ELSE 'OTHER - UNAVAILABLE USER' END AS label,
  CASE WHEN b IN ('[deleted]', 'deleted') THEN '[deleted]' WHEN b IN ('[removed]', 'removed') THEN '[removed]' WHEN b IN ('', 'none', 'null') THEN '[unavailable comment]' ELSE trim(body) END AS shown
FROM f""")
def speaker_text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + F.col("event_id") % n).cast("int"))
    speakers = at(["Ann", "[deleted]", " None ", "AutoModerator", "fix_BOT", "abbot", "null"], 7)
    bodies = at(["[removed]", " Deleted", "none", "hello", "", "fine words", "[deleted]", "ok", "NULL"], 9)
    e = table(spark, sf_dir, "events").select("event_id", speakers.alias("speaker"), bodies.alias("body"))
    return e.select(
        "event_id",
        text.unusable_speaker("speaker").alias("bad_speaker"),
        text.unusable_text("body").alias("bad_text"),
        text.context_label("speaker", "body").alias("label"),
        text.context_text("body").alias("shown"),
    )


@query("SELECT doc_id, lang FROM documents WHERE lower(trim(lang)) IN ('en', 'fr') AND lower(trim(source)) NOT IN ('src3')")
def include_exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = splits.include_exclude(table(spark, sf_dir, "documents"), "lang", include=[" EN", "fr"])
    return splits.include_exclude(d, "source", exclude=["SRC3 "]).select("doc_id", "lang")


def _copies(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    docs = copyscan.with_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    sources = copyscan.with_words(table(spark, sf_dir, "benchmark"), "text")
    return copyscan.runs(docs, sources, ["doc_id"], ["item_id"], [], n)


_RUNS = r"""
tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_'']+'), lambda w: replace(lower(w), 'ß', 'ss')) AS w FROM documents),
src AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_'']+'), lambda w: replace(lower(w), 'ß', 'ss')) AS w FROM benchmark),
a AS (SELECT doc_id, i - 1 AS ri, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM tok WHERE len(w) >= 8)),
b AS (SELECT item_id, i - 1 AS si, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM src WHERE len(w) >= 8)),
j AS (SELECT doc_id, item_id, ri, ri - si AS d, ri - row_number() OVER (PARTITION BY doc_id, item_id, ri - si ORDER BY ri) AS island FROM a JOIN b USING (g)),
r AS (SELECT doc_id, item_id, d, min(ri) AS response_start, max(ri) + 8 AS response_end, min(ri) - d AS source_start, max(ri) - min(ri) + 8 AS tokens FROM j GROUP BY doc_id, item_id, d, island)
"""


@query(f"WITH {_RUNS} SELECT doc_id, item_id, max(tokens) AS longest FROM r GROUP BY 1, 2")
def copy_scan_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copyscan.longest(_copies(spark, sf_dir, 8), ["doc_id", "item_id"])


@query(f"WITH {_RUNS} SELECT doc_id, item_id, response_start, response_end, source_start, tokens FROM r")
def copy_scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir, 8)


_CLASH = "s.response_start < {p}.e AND {p}.s < s.response_end"


def _greedy_sql() -> str:
    """Three times the best span that meets none of those chosen before."""
    best = "arg_max(struct_pack(s := s.response_start, e := s.response_end, n := s.tokens), s.tokens * 1000000000 - s.response_start)"
    return f"""WITH {_RUNS}, s AS (SELECT DISTINCT doc_id, response_start, response_end, tokens FROM r),
c1 AS (SELECT doc_id, {best} AS p1 FROM s GROUP BY 1),
c2 AS (SELECT c1.doc_id, any_value(p1) AS p1, {best} AS p2 FROM s JOIN c1 USING (doc_id) WHERE NOT ({_CLASH.format(p="p1")}) GROUP BY 1),
c3 AS (SELECT c2.doc_id, {best} AS p3 FROM s JOIN c2 USING (doc_id) WHERE NOT ({_CLASH.format(p="p1")}) AND NOT ({_CLASH.format(p="p2")}) GROUP BY 1),
picked AS (SELECT doc_id, p1 AS p FROM c1 UNION ALL SELECT doc_id, p2 FROM c2 UNION ALL SELECT doc_id, p3 FROM c3)
SELECT doc_id, p.n AS tokens, p.s AS response_start, p.e AS response_end FROM picked"""


@query(_greedy_sql())
def copy_scan_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = copyscan.greedy(_copies(spark, sf_dir, 8), ["doc_id"])
    return got.select("doc_id", F.explode("chosen").alias("c")).select("doc_id", (-F.col("c.o")).alias("tokens"), F.col("c.s").alias("response_start"), F.col("c.e").alias("response_end"))


@query(f"WITH {_RUNS} SELECT doc_id, max(tokens) AS longest, max(tokens) >= 20 AS leaks FROM r GROUP BY 1")
def leakage_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copyscan.leaks(_copies(spark, sf_dir, 8), ["doc_id"], 20)


@query("""SELECT doc_id, position(right(sha256(source || '|' || doc_id::VARCHAR || '|' || n_chars::VARCHAR || '|' || text), 1) IN '0123456789abcdef') % 2 = 1 AS generated_is_b FROM documents""")
def ab_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scoring.generated_is_b(F.col("source"), F.col("doc_id"), F.col("n_chars"), F.col("text")).alias("generated_is_b"))


# judge output made of ids: fenced, with prose, broken, rating only
def _sides(sql: bool) -> list[tuple[str, int, int]]:
    names = [f"{c}_{s}" for s in "ab" for c in scoring.CRITERIA] + [f"{p}_{s}" for s in "ab" for p in scoring.PENALTIES]
    return [(name, 3 + 2 * i, 5 + i) for i, name in enumerate(names)]


_FIELDS = " || ', ' || ".join(f"'\"{n}\": ' || ((doc_id * {a}) % {m}) * 0.25" for n, a, m in _sides(True))
_RAW = f"""CASE doc_id % 5 WHEN 0 THEN 'Sure.' || chr(10) || '```json' || chr(10) || '{{' || {_FIELDS} || '}}' || chr(10) || '```' WHEN 1 THEN 'I say {{' || {_FIELDS} || ', "reasoning": "r"}} so.'
 WHEN 2 THEN '{{"rating": ' || (doc_id % 9) || '}}' WHEN 3 THEN 'final rating: ' || (1 + doc_id % 7) || ' because {{ it' ELSE '{{"immediate_target_score_a": "x", "human_goal_score_b": 1}}' END"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select("doc_id")
    fields = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), (F.col("doc_id") * a % m * 0.25).cast("decimal(10,2)").cast("string")) for n, a, m in _sides(False)])
    kind = F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("Sure.\n```json\n{"), fields, F.lit("}\n```")))
        .when(kind == 1, F.concat(F.lit("I say {"), fields, F.lit(', "reasoning": "r"} so.')))
        .when(kind == 2, F.concat(F.lit('{"rating": '), (F.col("doc_id") % 9).cast("string"), F.lit("}")))
        .when(kind == 3, F.concat(F.lit("final rating: "), (1 + F.col("doc_id") % 7).cast("string"), F.lit(" because { it")))
        .otherwise(F.lit('{"immediate_target_score_a": "x", "human_goal_score_b": 1}'))
    )
    return d.withColumn("raw", raw).withColumn("j", scoring.pairwise("raw"))


def _side_sql(s: str) -> str:
    at = {n: f"((doc_id * {a}) % {m}) * 0.25" for n, a, m in _sides(True)}
    base = " + ".join(at[f"{c}_{s}"] for c in scoring.CRITERIA)
    lost = " + ".join(f"least(1, {at[f'{p}_{s}']})" for p in scoring.PENALTIES)
    return f"greatest(0, ({base})::DOUBLE - ({lost})::DOUBLE / 4 * 3)"


_GAP = "CASE WHEN gap <= -2 THEN 1 WHEN gap <= -1 THEN 2 WHEN gap <= -0.25 THEN 3 WHEN gap < 0.25 THEN 4 WHEN gap < 1 THEN 5 WHEN gap < 2 THEN 6 ELSE 7 END"
_JUDGED = f"""j0 AS (SELECT doc_id, doc_id % 5 AS kind, {_side_sql("a")} AS a, {_side_sql("b")} AS b FROM labels),
j1 AS (SELECT *, b - a AS gap FROM j0),
j AS (SELECT doc_id, CASE WHEN kind < 2 THEN a ELSE 0 END AS score_a, CASE WHEN kind < 2 THEN b ELSE 0 END AS score_b, CASE WHEN kind < 2 THEN gap ELSE 0 END AS gap,
  CASE WHEN kind < 2 THEN {_GAP} WHEN kind = 2 AND doc_id % 9 BETWEEN 1 AND 7 THEN doc_id % 9 WHEN kind = 3 THEN 1 + doc_id % 7 END::INT AS rating,
  kind = 3 OR kind = 4 OR (kind = 2 AND doc_id % 9 NOT BETWEEN 1 AND 7) AS parse_error FROM j1)"""


@query(f"WITH {_JUDGED} SELECT doc_id, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(gap, 6) AS gap, coalesce(rating, 0)::INT AS rating, parse_error FROM j")
def pairwise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    return j.select("doc_id", *[F.round(f"j.{c}", 6).alias(c) for c in ("score_a", "score_b", "gap")], F.coalesce("j.rating", F.lit(0)).alias("rating"), "j.parse_error")


@query("SELECT event_id, " + _GAP.replace("gap", "(value / 20 - 2.5)") + "::INT AS rating FROM events")
def gap_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scoring.gap_rating(F.col("value") / 20 - 2.5).cast("int").alias("rating"))


@query(f"""WITH {_JUDGED}, o AS (SELECT doc_id % 40 AS thread, CASE WHEN parse_error OR rating IS NULL THEN 0 WHEN doc_id % 2 = 0 THEN rating ELSE 8 - rating END AS s FROM j)
SELECT thread, round(avg(s), 6) AS mean_score, count(*) AS n FROM o GROUP BY 1""")
def thread_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    score = scoring.oriented(F.col("j.rating"), F.col("doc_id") % 2 == 0, F.col("j.parse_error"))
    got = j.select((F.col("doc_id") % 40).alias("thread"), score.alias("s"))
    return got.groupBy("thread").agg(scoring.rounded(F.avg("s")).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE least(1, (doc_id % 13) * 0.125) END::DOUBLE AS context_specificity,
  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE (doc_id % 5) * 0.25 END::DOUBLE AS user_evidence_compatibility,
  round(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN least(1, (doc_id % 11) * 0.25) ELSE (least(1, (doc_id % 13) * 0.125) + (doc_id % 5) * 0.25) / 2 END::DOUBLE, 6) AS overall,
  doc_id % 7 = 0 AS parse_error FROM labels""")
def specificity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    num = lambda c: (c).cast("decimal(10,3)").cast("string")
    raw = F.concat(
        F.lit('x {"context_specificity": {"score": '), num(n % 13 * F.lit(0.125)), F.lit(', "reason": "a"}, "user_evidence_compatibility": '),
        F.when(n % 7 == 0, F.lit("1")).otherwise(F.concat(F.lit('{"score": "'), num(n % 5 * F.lit(0.25)), F.lit('"}'))),
        F.when(n % 3 == 0, F.concat(F.lit(', "overall": '), num(n % 11 * F.lit(0.25)))).otherwise(F.lit("")), F.lit("} y"),
    )
    got = table(spark, sf_dir, "labels").select("doc_id", scoring.specificity(raw).alias("s"))
    return got.select("doc_id", "s.context_specificity", "s.user_evidence_compatibility", F.round("s.overall", 6).alias("overall"), "s.parse_error")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE least(1, (doc_id % 9) * 0.2) END::DOUBLE AS raw_score,
  CASE WHEN doc_id % 6 = 0 OR doc_id % 4 = 1 THEN 0 ELSE least(1, (doc_id % 9) * 0.2) END::DOUBLE AS score, doc_id % 4 = 1 AND doc_id % 6 <> 0 AS flagged, doc_id % 6 = 0 AS parse_error FROM labels""")
def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.concat(
        F.lit('{"score": '), (n % 9 * F.lit(0.2)).cast("decimal(10,1)").cast("string"), F.lit(', "wrong_perspective": '), F.when(n % 4 == 1, F.lit("true")).otherwise(F.lit('"no"')),
        F.when(n % 6 == 0, F.lit("")).otherwise(F.lit(', "thought": "t"')), F.lit("}"),
    )
    got = table(spark, sf_dir, "labels").select("doc_id", scoring.similarity(raw).alias("s"))
    return got.select("doc_id", F.round("s.raw_score", 6).alias("raw_score"), F.round("s.score", 6).alias("score"), "s.flagged", "s.parse_error")


@query(r"""WITH w AS (SELECT d.doc_id, len(regexp_extract_all(d.text, '[\p{L}\p{N}\p{M}_'']+')) AS g, len(regexp_extract_all(b.text, '[\p{L}\p{N}\p{M}_'']+')) AS h
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
p AS (SELECT doc_id, g / greatest(h, 1)::DOUBLE AS ratio FROM w)
SELECT doc_id, round(least(greatest(0.8 - ratio, 0) / 0.8 * 0.35 + greatest(ratio - 1.1, 0) / 1.1 * 0.15, 0.25), 6) AS penalty,
  round(greatest(0, 0.9 * (least((1 + doc_id % 7)::DOUBLE, 5) - 1) / 6 + 0.1 - least(greatest(0.8 - ratio, 0) / 0.8 * 0.35 + greatest(ratio - 1.1, 0) / 1.1 * 0.15, 0.25)), 6) AS reward FROM p""")
def length_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    # the sources are a small table; Spark broadcasts it while it is below the session's bound
    j = d.join(b, F.col("doc_id") % b.count() == F.col("item_id"))
    penalty = scoring.length_penalty(text.word_count("text"), text.word_count("truth"))
    reward = scoring.pairwise_reward(1 + F.col("doc_id") % 7, F.lit(0.1), penalty, F.col("text"), F.lit(True))
    return j.select("doc_id", scoring.rounded(penalty).alias("penalty"), scoring.rounded(reward).alias("reward"))


_GENERATED = """CASE conv_id % 4 WHEN 0 THEN '<reasoning>I think so</reasoning>' || chr(10) || '[HUMAN]: ' || text WHEN 1 THEN 'no tags at all, ' || text
 WHEN 2 THEN '<reasoning>one<reasoning>two</reasoning> 12' || chr(10) || '[HUMAN]: a' || chr(10) || '[HUMAN]: b' ELSE '<b>x</b> <response>' || text || '</response>' END"""


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 4
    made = (
        F.when(kind == 0, F.concat(F.lit("<reasoning>I think so</reasoning>\n[HUMAN]: "), "text"))
        .when(kind == 1, F.concat(F.lit("no tags at all, "), "text"))
        .when(kind == 2, F.lit("<reasoning>one<reasoning>two</reasoning> 12\n[HUMAN]: a\n[HUMAN]: b"))
        .otherwise(F.concat(F.lit("<b>x</b> <response>"), "text", F.lit("</response>")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", made.alias("made"))


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS opens, CASE conv_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS closes,
  CASE conv_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS humans, conv_id % 4 >= 2 AS hard_fail,
  round(CASE WHEN conv_id % 4 = 0 AND trim(text) <> '' THEN 0.1 ELSE 0 END::DOUBLE, 6) AS bonus FROM conversations""")
def format_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generated(spark, sf_dir).withColumn("p", scoring.format_parts("made"))
    return g.select(
        "conv_id", "turn", F.col("p.reasoning_open_count").alias("opens"), F.col("p.reasoning_close_count").alias("closes"), F.col("p.human_prefix_count").alias("humans"),
        F.col("p.format_hard_fail").alias("hard_fail"), F.round(scoring.format_bonus(F.col("p")), 6).alias("bonus"),
    )


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^{_WS}', ''), '{_WS}$', '') AS text FROM conversations)
SELECT conv_id, turn, sha256(CASE conv_id % 4 WHEN 0 THEN '<reasoning>I think so</reasoning>' WHEN 1 THEN '' WHEN 2 THEN '<reasoning>one<reasoning>two</reasoning> 12' || chr(10) || '[HUMAN]: a' ELSE '<b>x</b>' END) AS reasoning_sha,
  sha256(CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN 'no tags at all, ' || text WHEN 2 THEN 'b' ELSE text END) AS response_sha FROM t""")
def reasoning_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generated(spark, sf_dir).withColumn("r", scoring.reasoning_and_response("made"))
    return g.select("conv_id", "turn", F.sha2("r.reasoning", 256).alias("reasoning_sha"), F.sha2("r.response", 256).alias("response_sha"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN contains(coalesce(text, ''), '?') ELSE true END AS question FROM documents""")
def question_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    body = F.coalesce("text", F.lit(""))
    made = F.when(n == 0, F.concat(F.lit("[HUMAN]: Why not "), body)).when(n == 1, F.concat(F.lit("Well, "), body)).otherwise(F.concat(body, F.lit(" so it goes?")))
    return table(spark, sf_dir, "documents").select("doc_id", text.question_like(made).alias("question"))


@query("""SELECT metric, round(mean, 6) AS mean, round(active_mean, 6) AS active_mean FROM (
  SELECT 'quality' AS metric, avg(quality)::DOUBLE AS mean, avg(CASE WHEN doc_id % 3 > 0 THEN quality END) AS active_mean FROM labels
  UNION ALL SELECT 'toxic', avg(toxic), avg(CASE WHEN doc_id % 3 > 0 THEN toxic END) FROM labels)""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("active", F.col("doc_id") % 3)
    got = groups.batch_metrics(rows, ["quality", "toxic"], "active")
    return got.select("metric", scoring.rounded(F.col("mean")).alias("mean"), scoring.rounded(F.col("active_mean")).alias("active_mean"))


# a sample's fields of its document: some batches lack one, some fields are no numbers, one mask is none
_SAMPLES = """b AS (SELECT d.doc_id % 5 AS step, d.doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, coalesce(n_chars, 0)::DOUBLE AS n_chars,
  coalesce(length(source), 0)::DOUBLE AS n_source FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT step, avg(quality) AS q, avg(toxic) AS t, avg(n_chars) AS n, avg(n_source) AS s, avg(n_chars) FILTER (WHERE toxic > 0) AS masked, count(*) AS size, count(*) FILTER (WHERE doc_id % 3 > 0) AS n_part FROM b GROUP BY 1)"""


@query(f"""WITH {_SAMPLES} SELECT step, metric, round(value, 6) AS value FROM (
  SELECT step, unnest(['reward/score/mean', 'reward/total_score/mean', 'critic/score/mean']) AS metric, q AS value FROM m
  UNION ALL SELECT step, unnest(['reward/raw_reward/mean', 'critic/rewards/mean']), n FROM m WHERE step > 0
  UNION ALL SELECT step, unnest(['reward/format_score/mean', 'reward/format_bonus/mean']), t FROM m
  UNION ALL SELECT step, 'reward/format_source/mean', s FROM m
  UNION ALL SELECT step, unnest(['reward/source_copy/mean', 'reward/source_copy/rate', 'reward/source_copy_rate/mean']), 1 - q FROM m
  UNION ALL SELECT step, 'reward/length_new/mean', n + 1 FROM m
  UNION ALL SELECT step, 'reward/length_part/mean', t FROM m WHERE n_part = size
  UNION ALL SELECT step, 'reward/train/response/score/mean', masked FROM m WHERE masked IS NOT NULL
  UNION ALL SELECT step, 'reward/train/other/score/mean', n FROM m)""")
def open_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").join(d, "doc_id").withColumn("step", F.col("doc_id") % 5)
    n = F.coalesce("n_chars", F.lit(0))
    fields = {
        "score": F.col("quality"), "raw_reward": F.when(F.col("step") > 0, n), "format_score": F.col("toxic").cast("string"),
        "format_source": F.coalesce(F.length("source"), F.lit(0)), "wrong_perspective": F.concat(F.lit("no number "), F.coalesce("lang", F.lit(""))),
        "source_copy": F.col("quality") == 0, "train/response:score": n, "train/active/response": F.col("toxic"), "train/other:score": n,
        "train/active/other": F.lit("always"), "reward_extra_info": F.struct(F.lit(7).alias("score"), (n + 1).alias("length_new"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic")).alias("length_part")),
    }
    samples = rows.select("step", F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))).alias("info"))
    return metrics.open_metrics(samples, ["step"], "info").select("step", "metric", scoring.rounded(F.col("value")).alias("value"))


def _words_and_gaps(texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Stands in for a tokenizer: stretches of white space and of other characters; an id is a length."""
    spans = [[m.span() for m in re.finditer(r"[ \t\n]+|[^ \t\n]+", t)] for t in texts]
    return [([b - a for a, b in s], s) for s in spans]


@query("""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
m AS (SELECT conv_id, turn, last, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM conversations JOIN l USING (conv_id) WHERE turn <= last),
t AS (SELECT conv_id, string_agg(line, '' ORDER BY turn) AS whole, length(coalesce(string_agg(line, '' ORDER BY turn) FILTER (WHERE turn < last), '') || '<|im_start|>assistant' || chr(10)) AS prefix FROM m GROUP BY 1),
k AS (SELECT *, list_transform(regexp_extract_all(whole, '[ \t\n]+|[^ \t\n]+'), lambda x: length(x)) AS sizes FROM t),
e AS (SELECT *, list_transform(range(1, len(sizes) + 1), lambda i: list_sum(sizes[1:i])) AS ends FROM k),
b AS (SELECT conv_id, len(sizes) AS n, len(list_filter(ends, lambda x: x <= prefix)) AS first, len(list_filter(ends, lambda x: x <= length(whole) - 11)) AS behind FROM e)
SELECT conv_id, n::INTEGER AS n_tokens, sha256(repeat('0', first) || repeat('1', behind - first) || repeat('0', n - behind)) AS mask_sha FROM b""")
def learning_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = c.join(last, "conv_id").where("turn <= _last").groupBy("conv_id").agg(said.alias("m"))
    rows = rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    got = tokens.learning_tokens(tokens.learning_texts(rows, "messages").drop("messages"), _words_and_gaps)
    return got.select("conv_id", F.size("input_ids").alias("n_tokens"), F.sha2(F.array_join("completion_mask", ""), 256).alias("mask_sha"))


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS source, 'train' AS split, 0 AS f FROM customer),
b AS (SELECT doc_id, NULL, source, 'val', 1 FROM documents), c AS (SELECT s_suppkey, s_name, NULL, 'test', 2 FROM supplier),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT id, name, source, split, row_number() OVER (ORDER BY f, id) - 1 AS row_ord FROM u""")
def ordered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return ordered.ordered_union({"train": a, "val": b, "test": c}, ["id"])


@query(f"""
WITH q AS (SELECT o_custkey AS u FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 3),
r AS (SELECT u, row_number() OVER (ORDER BY sha256('42:heldout:' || u::VARCHAR), u) AS user_rank, floor(count(*) OVER () * 0.4::DOUBLE) AS held FROM q),
s AS (SELECT u, CASE WHEN user_rank <= held THEN 'heldout' ELSE 'train' END AS role FROM r WHERE user_rank <= held OR user_rank - held - 3 BETWEEN 1 AND 40),
t AS (SELECT u, o_orderkey AS post_id, role, count(*) OVER (PARTITION BY u) AS n, row_number() OVER (PARTITION BY u ORDER BY sha256('42:conv:' || u::VARCHAR || ':' || o_orderkey::VARCHAR), o_orderkey) AS place
  FROM (SELECT DISTINCT o_custkey AS u, o_orderkey FROM orders) o JOIN s USING (u)),
k AS (SELECT *, least(2 + {_int_hash("'42:' || u::VARCHAR", 5)}, greatest(1, n - 1)) AS k FROM t),
e AS (SELECT *, n - k AS m, CASE WHEN n - k > 1 THEN least(greatest(1, floor((n - k) * 0.3::DOUBLE)), n - k - 1) ELSE greatest(1, floor((n - k) * 0.3::DOUBLE)) END AS e FROM k)
SELECT u AS user_id, post_id, role, place, CASE WHEN place <= k THEN 'history' WHEN role = 'train' THEN 'train' WHEN place <= k + e THEN 'val' ELSE 'test' END AS split FROM e
""")
def role_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("post_id"))
    roles = splits.user_roles(rows.where("user_id is not null"), "user_id", "post_id", least=3, heldout=0.4, offset=3, most_users=40)
    return splits.role_conversations(rows, "user_id", "post_id", roles, share=0.3)


_KEY = "'7:response:prompt_idx:' || event_id || ':hash:' || sha1(event_id || chr(10) || user_id || repeat(chr(10), 5) || event_type || repeat(chr(10), 2))"


@query(f"""WITH k AS (SELECT event_id, {_KEY} AS group_key FROM events)
SELECT event_id, group_key, ((('0x' || substr(sha1(group_key), 1, 8))::BIGINT % 6) * (4294967296 % 6) + ('0x' || substr(sha1(group_key), 9, 8))::BIGINT % 6) % 6 AS worker FROM k""")
def group_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = groups.group_key(F.lit(7), {"index": F.col("event_id"), "user_id": F.col("user_id"), "context": F.col("event_type")})
    return e.select("event_id", key.alias("group_key")).withColumn("worker", groups.bucket(F.col("group_key"), 6))


@query("""WITH r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS group_no FROM events)
SELECT user_id, event_id, group_no, count(*) OVER (PARTITION BY user_id, group_no) AS group_size FROM r""")
def group_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return groups.group_by_count(rows, "user_id", ["ts", "event_id"]).drop("ts")


@query("""SELECT conv_id % 9 AS user_id, sha256(arg_min(text, conv_id * 1000 + turn)) AS history_sha FROM conversations WHERE trim(text) <> '' AND role = 'assistant' GROUP BY 1""")
def first_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("user_id", F.col("conv_id") % 9)
    got = splits.first_non_blank(rows, "user_id", "text", ["conv_id", "turn"])
    return got.select("user_id", F.sha2("text", 256).alias("history_sha"))


@query("""SELECT o_orderkey AS post_id, coalesce(p.persona, a.persona, '') AS persona FROM orders
LEFT JOIN (SELECT c_custkey AS k, c_name AS persona FROM customer WHERE c_custkey % 3 = 0) p ON p.k = o_custkey
LEFT JOIN (SELECT c_custkey AS k, c_name AS persona FROM customer WHERE c_custkey % 3 = 0) a ON a.k = o_custkey + 1""")
def persona_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    personas = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(" ").alias("persona"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), "o_custkey", (F.col("o_custkey") + 1).alias("alias"))
    return prompts.lookup_persona(rows, personas, ["o_custkey", "alias"]).select("post_id", "persona")


@query("""SELECT event_id, md5(coalesce(json_extract_string(props, '$.' || k), '')) AS value_md5 FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    first = F.element_at(F.json_object_keys("props"), 1)
    value = F.element_at(F.from_json("props", "map<string,string>"), first)
    return e.select("event_id", F.md5(F.coalesce(value, F.lit(""))).alias("value_md5"))


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.target_rows(turns.with_position(turns.selected_turns(_messages(spark, sf_dir))))
    mode = F.element_at(F.array(*[F.lit(m) for m in prompts.MODES]), (1 + F.col("conv_id") % 3).cast("int"))
    return rows.withColumn("mode", mode).withColumn("messages", prompts.prompt_messages(F.lit("[THREAD SOURCE]\npics\nearlier words"), "context", F.lit("calm"), F.col("mode"), "TASK"))


@query(f"""WITH {_PATHS}, c AS (SELECT a.conv_id, a.target_idx, string_agg(b.line, chr(10) ORDER BY b.target_idx) AS context
  FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.target_idx < a.target_idx GROUP BY 1, 2)
SELECT conv_id, target_idx, sha256(CASE WHEN conv_id % 3 = 0 THEN 'TASK' ELSE '[USER PERSONA]' || chr(10) || 'calm' || chr(10) || chr(10) || 'TASK' END) AS system_sha,
 sha256(CASE WHEN conv_id % 3 = 1 THEN '' ELSE '[USER HISTORY]' || chr(10) || 'earlier words' || chr(10) || chr(10) END || '[CURRENT CONTEXT]' || chr(10) || rtrim(context)) AS user_sha FROM c""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _prompted(spark, sf_dir)
    return m.select("conv_id", "target_idx", F.sha2(F.col("messages")[0]["content"], 256).alias("system_sha"), F.sha2(F.col("messages")[1]["content"], 256).alias("user_sha"))


@query(f"""WITH {_PATHS} SELECT conv_id, target_idx, sha256('<reasoning>because</reasoning>' || chr(10) || '[HUMAN]: ' || user_text) AS assistant_sha FROM n WHERE target_idx > 0""")
def sft_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _prompted(spark, sf_dir)
    record = prompts.sft_record(F.col("messages"), "ground_truth", F.lit("<think> because </think>"))
    said = scoring.field(F.parse_json(record), "messages[2].content")
    return m.select("conv_id", "target_idx", F.sha2(said, 256).alias("assistant_sha"))


@query("""SELECT o_orderkey AS post_id, row_number() OVER (ORDER BY sha256('42:' || o_orderkey::VARCHAR), o_orderkey) AS shuffle_ord FROM orders""")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"))
    return splits.shuffled(rows, "post_id", 42)


@query("""SELECT user_id, round(greatest(-8, least(0, avg(-value / 50))) + 0.1, 6) AS reward FROM events GROUP BY 1""")
def logprob_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(-F.col("value") / 50).alias("m"))
    return e.select("user_id", scoring.rounded(scoring.logprob_reward(F.col("m"), F.lit(0.1))).alias("reward"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(DISTINCT source) AS n_sources, count(*) FILTER (WHERE n_chars < 100) AS n_short FROM documents""")
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_distinct("source").alias("n_sources"), F.count_if(F.col("n_chars") < 100).alias("n_short"))
