"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import funnel, jaccard, langid, license, linededup, mixing, neardup, packing, paragraphs, quality, tandem, warc, winnowing
from palaver.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license.scan_documents(load(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("found", lambda f: F.struct(f["confirmed"], f["score"], f["license"], f["similarity"])))
    got = got.withColumn("_best", best)
    return got.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licensed"),
        F.col("_best.license").alias("license"),
        F.round("_best.score", 6).alias("score"),
        F.round("_best.similarity", 6).alias("similarity"),
        F.coalesce(F.col("_best.confirmed"), F.lit(False)).alias("confirmed"),
        F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))).alias("licenses"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    learned = docs.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id")))
    return langid.predict(docs, langid.fit(learned))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.derive(warc.respond(load(spark, sf_dir, "pages")))
    return got.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(load(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.weigh(load(spark, sf_dir, "documents"), columns=["doc_id"])
    return got.select(
        F.col("_row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"), "kept"
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = winnowing.compare_with_edits(load(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest(F.col("picked")).alias("fingerprint"),
        winnowing.digest(F.col("edited_picked")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("picked.positions").cast("long").alias("n_picks"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neardup.near_documents(load(spark, sf_dir, "documents"), k=2)
    return got.select("doc_id", "n_shingles", "component_id", "kept")


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return paragraphs.repeats(docs).unionByName(paragraphs.passages(docs), allowMissingColumns=True).drop("th")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(load(spark, sf_dir, "documents")).drop("component_size")


def op12_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel_counts(load(spark, sf_dir, "clicks")).withColumnRenamed("client", "client_id")


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document (by the hash of its id) with a planted period towards the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    start, n = h // 10 % len(words), len(words)
    period = 1 + (n - start) // (3 + h // 10 % 8)
    return (words[:start] + words[start : start + period] * -(-(n - start) // period))[:n]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tandem.periodic_runs(load(spark, sf_dir, "documents"), edit=repeated)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    found = [op1_license_scan, op2_language_id, op3_warc_derivatives, op4_line_dedup, op5_quality_rules]
    found += [op6_source_mixing, op7_winnowing, op8_packing, op9_minhash_near_dedup, op10_paragraph_dedup]
    found += [op11_ngram_jaccard_join, op12_funnel_counts, op13_periodic_runs]
    return {f.__name__: f for f in found}


_OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, d.top IS NOT NULL AND d.top <> k.doc_id AS gone
  FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _op6_sql() -> str:
    m = mixing.MARGINS
    top = ", ".join(
        f"t_{x} AS (SELECT {x} FROM (SELECT {x}, sum(n_tokens) AS t FROM marked GROUP BY {x}) ORDER BY t DESC, {x} LIMIT {mixing.MAX_LEVELS})"
        for x in m
    )
    bounded = ", ".join(f"CASE WHEN {x} IN (SELECT {x} FROM t_{x}) THEN {x} ELSE '{mixing.OTHER}' END AS {x}" for x in m)
    sql = f"""
WITH counted AS (
  SELECT doc_id, text, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
         greatest(length(text), 1) AS size,
         greatest(length(text), 1) - length(translate(text, '#*$%&|<>{{}}=', '')) AS symbols,
         greatest(length(text), 1) - length(translate(text, '0123456789', '')) AS digits
  FROM documents
), marked AS (
  SELECT doc_id, text, source, lang, n_tokens,
         CASE WHEN text IS NULL OR n_tokens = 0 THEN 'blank' WHEN symbols * 25 >= size THEN 'markup'
              WHEN digits * 10 >= size THEN 'figures' WHEN n_tokens < 100 THEN 'note'
              WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic
  FROM counted
), {top}, levelled AS (SELECT doc_id, text, n_tokens, {bounded} FROM marked),
c0 AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM levelled GROUP BY ALL HAVING sum(n_tokens) > 0),
c1 AS (SELECT *, {", ".join(f"pow(sum(tokens) OVER (PARTITION BY {x})::DOUBLE, {mixing.ALPHA}) AS g_{x}, count(*) OVER (PARTITION BY {x}) AS k_{x}" for x in m)} FROM c0),
w0 AS (SELECT source, lang, topic, tokens, tokens::DOUBLE AS weight,
  {", ".join(f"g_{x} / sum(g_{x} / k_{x}) OVER () AS s_{x}" for x in m)} FROM c1)"""
    n = 0
    for _ in range(mixing.ROUNDS):
        for x in m:
            sql += f",\nw{n + 1} AS (SELECT * REPLACE (weight * s_{x} / sum(weight) OVER (PARTITION BY {x}) AS weight) FROM w{n})"
            n += 1
    sql += f""",
p0 AS (SELECT source, lang, topic, tokens, weight / sum(weight) OVER () AS weight, {mixing.BUDGET} * sum(tokens) OVER () AS goal, 0.0::DOUBLE AS p FROM w{n})"""
    for i in range(mixing.CAP_ROUNDS):
        sql += f""",
p{i + 1} AS (SELECT * REPLACE (CASE WHEN p >= 1 THEN 1.0 ELSE least(1.0, greatest(0.0, weight * (goal - sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) OVER ())
  / (sum(CASE WHEN p >= 1 THEN 0.0 ELSE weight END) OVER () * tokens))) END AS p) FROM p{i})"""
    return sql + f""", drawn AS (
  SELECT l.*, coalesce(c.p, 1.0) AS prob,
         ('0x' || substr(sha256('0:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / {mixing._UNIT} AS draw
  FROM levelled l LEFT JOIN p{mixing.CAP_ROUNDS} c USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS p, draw < prob AS kept FROM drawn
"""


def _near_sql(k: int, percent: int, last: str) -> str:
    """Components of documents by the Jaccard similarity of k-word shingles (percent of 100)."""
    shingle = " || ' ' || ".join(f"words[i + {j}]" for j in range(k))
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {k} + 2), lambda i: {shingle})) END AS set
  FROM w
), n AS (SELECT doc_id, len(set)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(set) AS h FROM s),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * inter >= {percent} * (p.n_shingles + q.n_shingles - inter)
), walk AS (
  WITH RECURSIVE r(doc_id, reached) AS (
    SELECT doc_id, doc_id FROM n
    UNION
    SELECT r.doc_id, CASE WHEN e.x = r.reached THEN e.y ELSE e.x END FROM r JOIN e ON e.x = r.reached OR e.y = r.reached
  ) SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT n.doc_id, n.n_shingles, walk.component_id{last} FROM n JOIN walk USING (doc_id)
"""


def _op12_sql() -> str:
    sql = "WITH d AS (SELECT DISTINCT client_id, kind, arrived_at AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL)"
    for f in funnel.FUNNELS:
        a = f.name
        sql += f", {a}x AS (SELECT client_id, t FROM d WHERE kind = '{f.exclude}')"
        sql += f", {a}1 AS (SELECT client_id, t AS t1, t, 0::BIGINT AS took FROM d WHERE kind = '{f.steps[0]}')"
        for k, kind in enumerate(f.steps[1:], 2):
            sql += f""", {a}k{k} AS (SELECT client_id, t FROM d WHERE kind = '{kind}'),
{a}n{k} AS (SELECT p.client_id, p.t1, p.t AS before, n.t FROM {a}{k - 1} p ASOF JOIN {a}k{k} n ON p.client_id = n.client_id AND p.t < n.t),
{a}{k} AS (SELECT n.client_id, n.t1, n.t, epoch_us(n.t) - epoch_us(n.before) AS took
  FROM {a}n{k} n ASOF LEFT JOIN {a}x x ON n.client_id = x.client_id AND n.before < x.t
  WHERE epoch_us(n.t) - epoch_us(n.t1) <= {f.horizon} AND (x.t IS NULL OR x.t > n.t))"""
    every = " UNION ALL ".join(f"SELECT '{f.name}' AS funnel, client_id, {k} AS step, took FROM {f.name}{k}" for f in funnel.FUNNELS for k in range(1, 5))
    n = ", ".join(f"count(*) FILTER (WHERE step = {k}) AS n{k}" for k in range(1, 5))
    t = ", ".join(f"max(took) FILTER (WHERE step = {k} AND place = (25 * size + 99) // 100) AS t{k}" for k in range(2, 5))
    return sql + f""", a AS ({every}), r AS (
  SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY took) AS place, count(*) OVER (PARTITION BY funnel, client_id, step) AS size FROM a
), g AS (SELECT funnel, client_id, {n}, max(step)::INTEGER AS deepest, {t} FROM r GROUP BY funnel, client_id)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_funnel_counts": _op12_sql(), "op4_line_dedup": _OP4_SQL, "op6_source_mixing": _op6_sql(), "op9_minhash_near_dedup": _near_sql(2, 80, ", n.doc_id = walk.component_id AS kept"), "op11_ngram_jaccard_join": _near_sql(3, 90, "")}
