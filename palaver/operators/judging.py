"""Judging of generated text: targets to jobs, jobs to judge output, output back to targets.

A generation is one row between the two ends, so a target with many generations spreads over
tasks; parallel lists are made only at the end, one entry per generation of a target.
Judge text comes from a hook (``streaming.groups.complete``) or from a table of answers.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import scoring
from palaver.functions.text import sanitise

JOB = ["user_id", "target_no", "gen_no"]
TARGET = ["user_id", "target_no"]
RESULT_SUFFIXES = {"pairwise": "_turing", "similarity": "_sim", "specificity": "_specificity"}  # fixed values


def first_users(rows: DataFrame, user: str, order: str, n: int) -> DataFrame:
    """Rows of the ``n`` users that appear first; the users are a top-n, not a sort of all."""
    first = rows.groupBy(user).agg(F.min(order).alias("_first")).orderBy("_first", user).limit(n)
    return rows.join(first.select(user), user, "left_semi")


def generation_counts(targets: DataFrame, generations: str = "generations") -> DataFrame:
    """One row: n_users, n_targets, n_generations."""
    return targets.agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count(F.lit(1)).alias("n_targets"),
        F.coalesce(F.sum(F.greatest(F.size(generations), F.lit(0))), F.lit(0)).cast("long").alias("n_generations"),
    )


def with_history(targets: DataFrame, order: str = "target_no") -> DataFrame:
    """``user_history``: the target's own, else the user's first that is not empty, else ''."""
    own = F.coalesce("user_history", F.lit(""))
    first = targets.where(own != "").groupBy("user_id").agg(F.min_by("user_history", order).alias("_h"))
    return targets.join(first, "user_id", "left").withColumn("user_history", F.when(own != "", own).otherwise(F.coalesce("_h", F.lit("")))).drop("_h")


def jobs(targets: DataFrame) -> DataFrame:
    """One row per generation: user_id, target_no, gen_no, response and the target's other columns.

    targets: user_id, target_no, generations (array of strings, or of structs with
    ``response``), generated_response and others. Without generations the single response
    counts, if it is not empty; a target with neither has no job.
    """
    element = targets.schema["generations"].dataType.elementType
    texts = F.col("generations")
    if element.simpleString().startswith("struct"):
        texts = F.transform(texts, lambda g: g["response"])
    single = F.coalesce("generated_response", F.lit("")) if "generated_response" in targets.columns else F.lit("")
    texts = F.when(F.size(texts) > 0, texts).when(single != "", F.array(single))
    rest = [c for c in targets.columns if c not in ("generations", "generated_response")]
    return targets.select(*rest, F.posexplode(texts).alias("gen_no", "response"))


def past_and_context(history: str | Column, context: str | Column) -> Column:
    """What a judge is shown before the candidates."""
    part = lambda name, c: F.concat(F.lit(f"## {name}\n"), F.trim(c))
    return F.concat_ws("\n\n", part("Earlier messages", history), part("Conversation so far", context))


def numbered(items: Column, name: str = "Candidate") -> Column:
    """Candidates as numbered blocks."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(f"## {name} "), (i + 1).cast("string"), F.lit("\n"), F.trim(x))), "\n\n")


def numbered_json(items: Column) -> Column:
    """Candidates as a JSON object by number."""
    return F.to_json(F.map_from_arrays(F.transform(items, lambda x, i: (i + 1).cast("string")), F.transform(items, lambda x: F.trim(x))))


def specificity_prompt() -> Column:
    task = F.lit("Rate from 0 to 1 how specific the candidate is to the conversation and how well it fits the earlier messages. Answer in JSON.")
    return F.concat_ws("\n\n", task, past_and_context("user_history", "context"), numbered(F.array("response")))


def similarity_prompt() -> Column:
    task = F.lit("Rate from 0 to 1 how close the candidate is to the true message. Answer in JSON.")
    return F.concat_ws("\n\n", task, past_and_context("user_history", "context"), numbered(F.array("ground_truth"), "True message"), numbered(F.array("response")))


def pairwise_jobs(found: DataFrame) -> DataFrame:
    """``jobs`` with sanitised texts, generated_is_b, response_a and response_b. A blank history is an error."""
    blank = F.coalesce("user_history", F.lit("")) == ""
    refused = F.raise_error(F.concat(F.lit("pairwise judging needs a history: user "), F.col("user_id").cast("string")))
    rows = found.withColumn("user_history", F.when(blank, refused).otherwise(sanitise("user_history")))
    rows = rows.withColumn("context", sanitise(F.coalesce("context", F.lit(""))))
    made, true = sanitise("response"), sanitise("ground_truth")
    rows = rows.withColumn("generated_is_b", scoring.generated_is_b(F.col("user_id"), F.col("post_id"), F.col("target_idx"), made))
    return rows.withColumn("response_a", F.when(F.col("generated_is_b"), true).otherwise(made)).withColumn("response_b", F.when(F.col("generated_is_b"), made).otherwise(true))


def pairwise_prompt() -> Column:
    task = F.lit("Which message did this person write? Score both by the criteria. Answer in JSON.")
    return F.concat_ws("\n\n", task, past_and_context("user_history", "context"), numbered(F.array("response_a", "response_b")))


def associate(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Each job with its answer's text ``raw``; null where there is none. answers: user_id, target_no, gen_no, raw."""
    return found.join(answers.select(*JOB, "raw"), JOB, "left")


def pairwise_outcome(rows: DataFrame) -> DataFrame:
    """score (the generated side's rating, 0 after a parse error), rating, parse_error and penalties of the generated side."""
    raw = F.coalesce("raw", F.lit(""))
    value = scoring.json_object(raw)
    rows = rows.withColumn("_j", scoring.pairwise(raw)).withColumn("_v", value)
    out = rows.withColumn("rating", F.coalesce("_j.rating", F.lit(0))).withColumn("parse_error", F.col("_j.parse_error"))
    out = out.withColumn("score", scoring.oriented(F.col("_j.rating"), F.col("generated_is_b"), F.col("_j.parse_error")).cast("double"))
    for name in scoring.PENALTIES:
        side = {s: scoring.unit(scoring.number(scoring.field(F.col("_v"), f"{name}_{s}"))) for s in "ab"}
        out = out.withColumn(name, F.coalesce(F.when(F.col("generated_is_b"), side["b"]).otherwise(side["a"]), F.lit(0.0)))
    return out.drop("_j", "_v")


def specificity_outcome(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_s", scoring.specificity(F.coalesce("raw", F.lit("")))).select("*", "_s.*").drop("_s")


def similarity_outcome(rows: DataFrame) -> DataFrame:
    """score, raw_score, flagged and parse_error; scores are 0 where nothing could be read."""
    return rows.withColumn("_s", scoring.similarity(F.coalesce("raw", F.lit("")))).select("*", "_s.*").drop("_s")


def gathered(results: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per target: ``keep``, ``generations`` and a list of each column, all in the order of gen_no."""
    entry = F.array_sort(F.collect_list(F.struct("gen_no", "response", *columns))).alias("_all")
    firsts = [F.first(c).alias(c) for c in keep or []]
    got = results.groupBy(*TARGET).agg(*firsts, entry)
    lists = [F.col(f"_all.{c}").alias(c) for c in columns]  # a field of an array of structs is an array
    return got.select(*TARGET, *(keep or []), F.col("_all.response").alias("generations"), *lists)


def judge(targets: DataFrame, kind: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of a results table. ``answer(jobs with prompt) -> (user_id, target_no, gen_no, raw)``.

    ``kind`` is pairwise, specificity or similarity. Pairwise results have ``mean_score``.
    """
    found = jobs(with_history(targets))
    keep = [c for c in ("post_id", "target_idx", "ground_truth", "context", "user_history") if c in found.columns]
    if kind == "pairwise":
        found = pairwise_jobs(found)
        scored = pairwise_outcome(associate(found, answer(found.withColumn("prompt", pairwise_prompt()))))
        got = gathered(scored, ["score", "rating", "generated_is_b", "parse_error", *scoring.PENALTIES], keep)
        return got.withColumn("mean_score", F.aggregate("score", F.lit(0.0), lambda a, x: a + x) / F.size("score"))
    prompt, outcome, columns = {
        "specificity": (specificity_prompt, specificity_outcome, ["overall", "context_specificity", "user_evidence_compatibility", "parse_error"]),
        "similarity": (similarity_prompt, similarity_outcome, ["score", "raw_score", "flagged", "parse_error"]),
    }[kind]
    return gathered(outcome(associate(found, answer(found.withColumn("prompt", prompt())))), columns, keep)


def consistent_groups(rows: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """``rows``; a group whose rows differ in a shared column (null counts as '') is an error."""
    same = F.lit(True)
    for c in shared:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        same = same & (F.min(text) == F.max(text))
    checked = rows.groupBy(key).agg(same.alias("_same"))
    refused = F.raise_error(F.concat(F.lit("rows of one group differ: "), F.col(key).cast("string"))).cast("boolean")
    return rows.join(checked, key).where(F.when(F.col("_same"), F.lit(True)).otherwise(refused)).drop("_same")


def group_rewards(rows: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """``reward`` of each row of checked groups. rows: key, shared columns, response, raw, bonus."""
    scored = similarity_outcome(consistent_groups(rows, key, shared))
    return scored.withColumn("reward", scoring.similarity_reward(F.col("score"), F.col("bonus"), F.col("response")))


def union_keys(rows: DataFrame, metrics: str) -> DataFrame:
    """The map column with every row's names: those that a row lacks are 0.0 (names are few, rows many)."""
    names = rows.select(F.explode(F.map_keys(metrics)).alias("_k")).agg(F.array_sort(F.collect_set("_k")).alias("_names"))
    out = rows.crossJoin(F.broadcast(names))  # one row
    own = F.coalesce(F.col(metrics), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    value = lambda k: F.when(F.map_contains_key(own, k), F.try_element_at(own, k)).otherwise(F.lit(0.0))
    return out.withColumn(metrics, F.map_from_arrays("_names", F.transform("_names", value))).drop("_names")


def metric_names(rows: DataFrame, metrics: str) -> DataFrame:
    """Distinct names of all rows, sorted, without blanks: one row, ``names``."""
    return rows.select(F.explode(F.map_keys(metrics)).alias("_k")).where(F.trim("_k") != "").agg(F.array_sort(F.collect_set("_k")).alias("names"))


def result_name(path: str, kind: str, folder: str = "results") -> str:
    """Where results of a generations table go: its name up to the last ``_gen``, and the judge's suffix."""
    name = os.path.basename(path.rstrip("/")).removesuffix(".pkl").removesuffix(".parquet")
    return os.path.join(folder, name[: name.rfind("_gen")] if "_gen" in name else name) + RESULT_SUFFIXES[kind]


def write_results(results: DataFrame, path: str, kind: str, folder: str) -> str:
    """Write a results table under its name and give the path."""
    out = result_name(path, kind, folder)
    results.write.mode("overwrite").parquet(out)
    return out


REWARDS: dict[str, Callable] = {}


def register(name: str):
    """Make a reward function known by name; a name is given once."""

    def add(f: Callable) -> Callable:
        if name in REWARDS:
            raise ValueError(f"reward {name} is already there")
        REWARDS[name] = f
        return f

    return add


def reward(name: str) -> Callable:
    if name not in REWARDS:
        raise KeyError(f"unknown reward {name}; known: {', '.join(sorted(REWARDS))}")
    return REWARDS[name]


register("pairwise")(scoring.pairwise_reward)
register("similarity")(scoring.similarity_reward)
register("logprob")(scoring.logprob_reward)
