"""Metrics of batches of samples whose fields are not known beforehand.

A sample holds a JSON object of fields, and may hold more in an object ``reward_extra_info``
inside it. Fields are found by taking the objects apart, and are summed in two levels: each
field of a batch first, next to the samples as they lie; then names with their aliases, which
are a small table joined to the fields found.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the metrics, what stands in for them, and the rates with their older names.
NAMES = [
    "score", "raw_reward", "unadjusted_raw_reward", "adjusted_raw_reward", "length_generated_words", "length_human_words", "length_ratio",
    "length_relative_diff", "length_shortfall_relative", "length_excess_relative", "length_short_deadband_violation", "length_long_deadband_violation",
    "length_short_penalty", "length_long_penalty", "length_penalty", "meaningful_thinking", "sim_response", "turing_response", "mixed_response",
    "format", "format_score", "format_bonus", "format_human_prefix", "format_nonempty_reasoning", "format_no_post_human_thinking",
    "format_reasoning_schema", "total_score", "source_copy", "wrong_perspective", "assistant_like_response", "unjustified_code_switching_response",
    "wrong_target_or_role_response", "unsupported_adversarial_reframing_response",
]
ALIASES = {"format_bonus": ["format_bonus", "format_score", "format"], "total_score": ["total_score", "score"]}
RATES = [
    "meaningful_thinking", "source_copy", "wrong_perspective", "assistant_like_response", "unjustified_code_switching_response",
    "wrong_target_or_role_response", "unsupported_adversarial_reframing_response", "format_human_prefix", "format_nonempty_reasoning",
    "format_no_post_human_thinking", "format_reasoning_schema",
]
OLDER_RATES = RATES[:7]
OPEN_PREFIXES = ["format_", "length_"]
EXTRA = "reward_extra_info"
COPIES = {"raw_reward": "critic/rewards/mean", "total_score": "critic/score/mean"}
_STAGE = "^train/([^:]+):score$"


def _number(value: Column) -> Column:
    """A JSON value as a number: booleans are 0 and 1, texts that read as numbers count, null is not a number (NaN)."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string").try_cast("double")
    plain = F.try_variant_get(value, "$", "double")
    truth = F.try_variant_get(value, "$", "boolean").cast("double")
    return F.when(kind == "VOID", F.lit(float("nan"))).when(kind == "BOOLEAN", truth).when(F.rlike(kind, F.lit("^(STRING|VARCHAR)")), text).otherwise(plain)


def field_means(samples: DataFrame, by: list[str], info: str) -> DataFrame:
    """by, key, extra and mean of the fields, and for stage scores ``active_mean``.

    ``info``: a VARIANT column. mean is null where a sample of the batch lacks the field or has something that is no
    number there. active_mean is over the samples whose ``train/active/<stage>`` is above 0:
    null where there is none, the plain mean where that field lacks or is no number.
    """
    own = F.try_variant_get(info, "$", "map<string,variant>")
    more = F.try_variant_get(info, f"$.{EXTRA}", "map<string,variant>")
    none = F.create_map().cast("map<string,variant>")

    def listed(fields: Column, extra: bool) -> Column:
        entries = F.map_entries(F.coalesce(fields, none))
        active = lambda e: F.try_element_at(F.col("_own"), F.concat(F.lit("train/active/"), F.regexp_extract(e["key"], _STAGE, 1)))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.lit(extra).alias("extra"), _number(e["value"]).alias("x"), _number(F.when(F.rlike(e["key"], F.lit(_STAGE)), active(e))).alias("a")))

    rows = samples.select(*by, own.alias("_own"), more.alias("_more"))
    rows = rows.select(*by, F.explode(F.concat(listed(F.col("_own"), False), listed(F.col("_more"), True))).alias("_f")).select(*by, "_f.*")
    on = F.col("a") > 0
    on = on & ~F.isnan("a")
    sums = rows.groupBy(*by, "key", "extra").agg(
        F.count("x").alias("_n"), F.avg("x").alias("_mean"), F.count("a").alias("_known"), F.count_if(on).alias("_on"), F.avg(F.when(on, F.col("x"))).alias("_active")
    )
    size = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    same = [F.col(f"_s_{c}").eqNullSafe(F.col(c)) for c in by]
    sized = sums.join(size.select(*[F.col(c).alias(f"_s_{c}") for c in by], "_size"), same)
    whole = F.col("_n") == F.col("_size")
    active = F.when(F.col("_known") < F.col("_size"), F.col("_mean")).when(F.col("_on") > 0, F.col("_active"))
    return sized.select(*by, "key", "extra", F.when(whole, F.col("_mean")).alias("mean"), F.when(whole, active).alias("active_mean"))


def name_table(spark: SparkSession, names: Iterable[str], aliases: dict[str, list[str]]) -> DataFrame:
    """name, ord, key: the fields that a metric is taken from, first to last."""
    rows = [(n, i, k) for n in names for i, k in enumerate(aliases.get(n, [n]))]
    return spark.createDataFrame(rows, "name string, ord int, key string")


def open_metrics(samples: DataFrame, by: list[str], info: str, names: list[str] = NAMES, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:  # noqa: B006
    """by, metric and value of every metric that a batch gives.

    A metric is the mean of the first of its fields that every sample has as a number; a field
    of the sample itself hides one of the same name in ``reward_extra_info``, even if it is no number.
    Fields that begin with format_ or length_ are metrics without being named. Rates are given a second
    time (and a third, under their older name), the raw reward and the total score under the
    names of the trainer. Stage scores are means over the active samples.
    """
    means = field_means(samples, by, info)
    own, more = F.max(F.when(~F.col("extra"), F.struct("mean"))), F.max(F.when(F.col("extra"), F.struct("mean")))
    fields = means.groupBy(*by, "key").agg(own.alias("_own"), more.alias("_more"))
    fields = fields.select(*by, "key", F.when(F.col("_own").isNotNull(), F.col("_own.mean")).otherwise(F.col("_more.mean")).alias("mean")).where("mean is not null")
    table = F.broadcast(name_table(samples.sparkSession, names, aliases))  # a row for each name and alias
    known = fields.join(table, "key").groupBy(*by, "name").agg(F.min_by("mean", "ord").alias("mean"))
    unnamed = ~F.col("key").isin(list(names)) & F.rlike("key", F.lit("^(" + "|".join(OPEN_PREFIXES) + ")"))
    every = known.unionByName(fields.where(unnamed).select(*by, F.col("key").alias("name"), "mean"))

    given = F.array(
        F.concat(F.lit("reward/"), F.col("name"), F.lit("/mean")),
        F.when(F.col("name").isin(RATES), F.concat(F.lit("reward/"), F.col("name"), F.lit("/rate"))),
        F.when(F.col("name").isin(OLDER_RATES), F.concat(F.lit("reward/"), F.col("name"), F.lit("_rate/mean"))),
        *[F.when(F.col("name") == n, F.lit(copy)) for n, copy in COPIES.items()],
    )
    rewards = every.select(*by, F.explode(F.array_compact(given)).alias("metric"), F.col("mean").alias("value"))
    stage = F.regexp_extract("key", _STAGE, 1)
    stages = means.where(~F.col("extra") & F.rlike("key", F.lit(_STAGE)) & F.col("active_mean").isNotNull())
    stages = stages.select(*by, F.concat(F.lit("reward/train/"), stage, F.lit("/score/mean")).alias("metric"), F.col("active_mean").alias("value"))
    return rewards.unionByName(stages)
