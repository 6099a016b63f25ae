"""Mixing sources to target weights (DataFrame operations only).

The tokens of the documents are summed by cell (source, language, topic). Iterative
proportional fitting rakes the cell weights in turn to the target share of each source,
language and topic. A document is then drawn with a probability in proportion to its
cell's raked weight over the cell's tokens, scaled so that the expected tokens meet the
budget with no probability over one, by a uniform number from a digest of its doc_id.

Every level is raked by its own, however many there are. Up to ``CELLS_AT_ONCE`` cells are
raked in one partition by window sums, without shuffles, and broadcast; the documents
themselves are not shuffled but for their sums by cell. More cells are raked as a table, by
sums and joins, and joined to the documents; the results are equal but for rounding.

Defined results: null in source or lang is a level of its own; a null text has no tokens
and joins its cell with its probability. A null doc_id draws by the text instead; repeated
rows draw alike. A target that names no level of the data is left out and the others are
scaled up; a level without a target weighs as ``default``. An empty table gives no row.
Extra columns pass through ``sample`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import WORD_RE, forget, materialise

#: Rounds of raking, each over all three margins.
ROUNDS = 12
#: Rounds that move what capped cells cannot give to the others.
CAP_ROUNDS = 6
#: Default target of a margin: its observed shares to this power.
ALPHA = 0.7
#: Expected share of the tokens that is drawn.
BUDGET = 0.7
#: Most cells that are raked in one partition and broadcast; a choice of plan.
CELLS_AT_ONCE = 20_000
#: Only the SQL that checks the query is bounded to so many levels of a margin.
MAX_LEVELS = 256
MARGINS = ("source", "lang", "topic")
#: The SQL's name of the levels beyond.
OTHER = "<other>"
NONE = "<none>"
_UNIT = 2.0**52


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A coarse topic by the form of the text, where no topic column is given."""
    size = F.greatest(F.char_length(text), F.lit(1))
    symbols = size - F.char_length(F.translate(text, "#*$%&|<>{}=", ""))
    digits = size - F.char_length(F.translate(text, "0123456789", ""))
    return (
        F.when(text.isNull() | (tokens == 0), "blank")
        .when(symbols * 25 >= size, "markup")
        .when(digits * 10 >= size, "figures")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def uniform(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the id."""
    name = F.coalesce(doc_id.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def _target(cells: DataFrame, margin: str, targets: dict[str, float] | None, default: float) -> Column:
    """The level's target share, as a window expression over the one partition of cells."""
    own = F.sum("tokens").over(Window.partitionBy(margin))
    if targets is None:
        return F.pow(own.cast("double"), F.lit(ALPHA))
    if not targets:
        return F.lit(float(default))
    named = F.map_from_arrays(F.array(*map(F.lit, targets)), F.array(*[F.lit(float(w)) for w in targets.values()]))
    return F.coalesce(F.try_element_at(named, F.col(margin)), F.lit(float(default)))


def rake(
    cells: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    *,
    rounds: int = ROUNDS,
    budget: float = BUDGET,
    default: float = 0.0,
) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their raked ``weight`` share and draw ``p``."""
    targets = targets or {}
    out = cells.where("tokens > 0").coalesce(1)
    for m in MARGINS:
        out = out.withColumn(f"_t_{m}", _target(out, m, targets.get(m), default))
    for m in MARGINS:  # shares over the levels: each cell carries its part of the level's target
        part = F.col(f"_t_{m}") / F.count(F.lit(1)).over(Window.partitionBy(m))
        out = out.withColumn("_part", part)
        out = out.withColumn(f"_t_{m}", F.try_divide(F.col(f"_t_{m}"), F.sum("_part").over(Window.partitionBy(F.lit(0)))))
    out = out.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for m in MARGINS:
            held = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_t_{m}"), held), F.lit(0.0)))
    whole = Window.partitionBy(F.lit(0))
    out = out.withColumn("weight", F.try_divide(F.col("weight"), F.sum("weight").over(whole)))
    out = out.withColumn("_goal", F.lit(float(budget)) * F.sum("tokens").over(whole))
    out = out.withColumn("p", F.lit(0.0))
    for _ in range(CAP_ROUNDS):
        full = F.col("p") >= 1.0
        out = out.withColumn("_left", F.col("_goal") - F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(whole))
        out = out.withColumn("_free", F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(whole))
        fair = F.try_divide(F.col("weight") * F.col("_left"), F.col("_free") * F.col("tokens"))
        out = out.withColumn("p", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(fair, F.lit(0.0))))))
    return out.select(*MARGINS, "tokens", "weight", "p")


def _rake_wide(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, rounds: int = ROUNDS, budget: float = BUDGET, default: float = 0.0) -> DataFrame:
    """``rake`` for any number of cells: each margin's sums by groups, joined to the cells."""
    targets = targets or {}
    spark = cells.sparkSession
    start = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    small = {}
    for m in MARGINS:
        levels = start.groupBy(m).agg(F.sum("tokens").cast("double").alias("_own"))
        if targets.get(m) is None:
            levels = levels.withColumn("_goal", F.pow("_own", F.lit(ALPHA)))
        else:
            named = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"`{m}` string, _named double")
            levels = levels.join(named, m, "left").withColumn("_goal", F.coalesce("_named", F.lit(float(default))))
        number, total = levels.agg(F.count(F.lit(1)), F.sum("_goal")).first()
        small[m] = number <= CELLS_AT_ONCE
        share = levels.select(m, F.try_divide("_goal", F.lit(total).cast("double")).alias(f"_t_{m}"))
        start = start.join(F.broadcast(share) if small[m] else share, m)
    out = materialise(start, "mix-rake")
    for _ in range(rounds):
        new = out
        for m in MARGINS:
            held = new.groupBy(m).agg(F.sum("weight").alias("_held"))
            new = new.join(F.broadcast(held) if small[m] else held, m)
            new = new.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_t_{m}"), F.col("_held")), F.lit(0.0))).drop("_held")
        new = materialise(new, "mix-rake")
        forget(out)
        out = new
    whole, tokens = out.agg(F.sum("weight"), F.sum("tokens")).first()
    out = out.withColumn("weight", F.try_divide(F.col("weight"), F.lit(whole).cast("double"))).withColumn("p", F.lit(0.0))
    for _ in range(CAP_ROUNDS):
        full = F.col("p") >= 1.0
        given, free = out.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        left = None if tokens is None else float(budget) * tokens - given
        fair = F.try_divide(F.col("weight") * F.lit(left).cast("double"), F.lit(free).cast("double") * F.col("tokens"))
        out = out.withColumn("p", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(fair, F.lit(0.0))))))
    return materialise(out.select(*MARGINS, "tokens", "weight", "p"), "mix-raked")


def _marked(docs: DataFrame, topic: str | None, seed: int, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` as _row, with source, lang, topic, n_tokens and draw."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE)
    row, tokens = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), n_tokens(F.col("text"))
    made = F.coalesce(F.col(f"`{topic}`").cast("string"), F.lit(NONE)) if topic else F.lit(None).cast("string")
    draw = uniform(F.col("doc_id"), F.col("text"), seed)
    out = docs.select(
        row, F.col("text").alias("_text"), level("source").alias("source"), level("lang").alias("lang"), made.alias("topic"), tokens.alias("n_tokens"), draw.alias("draw")
    )
    if not topic:
        out = out.withColumn("topic", form_topic(F.col("_text"), F.col("n_tokens")))
    return out.drop("_text")


def weigh(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, topic: str | None = None, seed: int = 0, columns: list[str] | None = None, **options
) -> DataFrame:
    """Every row of ``docs`` as ``_row``, with its levels, n_tokens, weight, p, draw and kept.

    ``columns`` names what ``_row`` has, all columns if None. Without the text among them the
    counted rows are narrow: they are written once, so that each text is read once.
    """
    marked = _marked(docs, topic, seed, docs.columns if columns is None else columns)
    if columns is not None and "text" not in columns:
        marked = materialise(marked, "mix-rows")
    cells = materialise(marked.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    if cells.count() <= CELLS_AT_ONCE:
        raked = F.broadcast(rake(cells, targets, **options).drop("tokens"))
    else:
        raked = _rake_wide(cells, targets, **options).drop("tokens")
    got = marked.join(raked, list(MARGINS), "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return got.withColumn("kept", F.col("draw") < F.col("p"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, **options) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    got = weigh(docs, targets, **options).where("kept")
    return got.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
