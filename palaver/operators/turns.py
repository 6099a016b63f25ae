"""Turn-based dialogues: path selection, target rows and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import normalise_space


def selected_turns(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """One path through a dialogue.

    messages: key, turn, pos, role, content, chosen, score, within. A turn has its last
    non-blank user text and its first chosen non-blank reply, else the reply with the best
    score (then the least ``within``, then the first). Turns without user text drop out.
    """
    m = messages.withColumn("content", normalise_space("content")).where("content != ''")
    user = F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("pos")))
    model = F.col("role") != "user"
    chosen = model & F.coalesce("chosen", F.lit(False))
    first_chosen = F.min_by(F.when(chosen, F.col("content")), F.when(chosen, F.col("pos")))
    merit = F.struct(
        F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-F.coalesce("within", F.lit(1_000_000))).alias("w"), (-F.col("pos")).alias("p")
    )
    best = F.max_by(F.when(model, F.col("content")), F.when(model, merit))
    got = m.groupBy(key, "turn").agg(user.alias("user_text"), F.coalesce(first_chosen, best).alias("reply"))
    return got.where("user_text is not null").withColumn("reply", F.coalesce("reply", F.lit("")))


def with_position(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns as one array per dialogue, in order: key, turns."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "user_text", "reply"))).alias("turns"))


def render_messages(turns: Column) -> Column:
    """Alternating lines of both sides; blanks are left out."""
    lines = F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.when(F.trim(t["user_text"]) != "", F.concat(F.lit("[HUMAN]: "), t["user_text"])),
                F.when(F.trim(t["reply"]) != "", F.concat(F.lit("[OTHER]: "), t["reply"])),
            ),
        )
    )
    return F.array_join(F.array_compact(lines), "\n")


def target_rows(dialogues: DataFrame, start: int = 1, key: str = "conv_id") -> DataFrame:
    """One row per turn from position ``start``: what went before is context, its user text the truth.

    Positions are places in the selected path; a row without truth takes no number.
    """
    rows = dialogues.select(key, F.col("turns"), F.posexplode("turns").alias("target_idx", "t"))
    rows = rows.where((F.col("target_idx") >= start) & (F.trim("t.user_text") != ""))
    context = render_messages(F.slice("turns", F.lit(1), F.col("target_idx")))
    rows = rows.select(key, F.col("target_idx").cast("long").alias("target_idx"), context.alias("context"), F.col("t.user_text").alias("ground_truth"))
    return rows.where("context != ''")


def numbered_history(dialogues: DataFrame, user: str, order: str) -> DataFrame:
    """A user's dialogues as numbered blocks. dialogues: user, order, turns."""
    body = render_messages(F.col("turns"))
    listed = F.array_sort(F.collect_list(F.struct(order, body.alias("b"))))
    blocks = F.transform(
        F.filter(listed, lambda x: x["b"] != ""),
        lambda x, i: F.concat(F.lit("<Conversation "), (i + 1).cast("string"), F.lit(">\n"), x["b"], F.lit("\n</Conversation "), (i + 1).cast("string"), F.lit(">")),
    )
    return dialogues.groupBy(user).agg(F.array_join(blocks, "\n\n").alias("history"))
