"""From raw archives to threads: channels and titles, roots, first activity, thread records.

utterances: archive_no, utterance_id, conversation_id, reply_to, speaker, text, ts, seq,
channel, title. metadata: archive_no, conversation_id, channel, title. ``seq`` is the place of
reading; archives are merged in the order of archive_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import opening_text, strip, unusable_speaker, unusable_text
from palaver.operators import splits, threads

#: Where a channel comes from, first to last (fixed orders of the entry points).
PRECEDENCE = {
    "archive": ["utterance", "conversation", "default"],
    "second_pass": ["utterance", "conversation", "first_pass", "default"],
    "corpus": ["conversation", "utterance", "default"],
    "single": ["utterance", "conversation"],
}
OP_LABEL = "OTHER - OP"


def _filled(text: str | Column) -> Column:
    return F.nullif(strip(F.coalesce(text, F.lit(""))), F.lit(""))


def merge_metadata(metadata: DataFrame, keys: list[str] = ["channel", "title"], order: str = "archive_no") -> DataFrame:  # noqa: B006
    """One row per conversation: of each key the last value that is not empty, else ''."""
    last = [F.coalesce(F.max_by(F.nullif(F.col(k), F.lit("")), F.when(F.nullif(F.col(k), F.lit("")).isNotNull(), F.col(order))), F.lit("")).alias(k) for k in keys]
    return metadata.groupBy("conversation_id").agg(*last)


def with_channel(utterances: DataFrame, metadata: DataFrame, entry: str = "archive", default: Column | str = "", first_pass: DataFrame | None = None) -> DataFrame:
    """``channel`` by the entry point's precedence and ``title`` (the conversation's, else its own)."""
    m = metadata.select("conversation_id", F.col("channel").alias("_mc"), F.col("title").alias("_mt"))
    out = utterances.join(m, "conversation_id", "left")
    found = {"utterance": _filled("channel"), "conversation": _filled("_mc"), "default": _filled(F.lit(default) if isinstance(default, str) else default)}
    if "first_pass" in PRECEDENCE[entry]:
        out = out.join(first_pass.select("conversation_id", F.col("channel").alias("_fc")), "conversation_id", "left") if first_pass is not None else out.withColumn("_fc", F.lit(None).cast("string"))
        found["first_pass"] = _filled("_fc")
    channel = F.coalesce(*[found[name] for name in PRECEDENCE[entry]], F.lit(""))
    title = F.coalesce(_filled("_mt"), _filled("title"), F.lit(""))
    return out.withColumn("channel", channel).withColumn("title", title).drop("_mc", "_mt", "_fc")


def with_root(utterances: DataFrame) -> DataFrame:
    """is_root, op_text and the flags bad_speaker and bad_text.

    A root answers nothing or has its conversation's id. One with an opening text (a title is
    enough) is usable whatever its speaker and text.
    """
    root = (F.coalesce("reply_to", F.lit("")) == "") | (F.col("utterance_id") == F.col("conversation_id"))
    out = utterances.withColumn("is_root", root)
    out = out.withColumn("op_text", F.when(root, opening_text("title", "text")).otherwise(F.lit("")))
    saved = F.col("is_root") & (F.col("op_text") != "")
    out = out.withColumn("bad_speaker", unusable_speaker("speaker") & ~saved)
    return out.withColumn("bad_text", unusable_text("text") & ~saved)


def first_activity(rooted: DataFrame, *, without_opener: bool = False) -> DataFrame:
    """user_id, conversation_id, first_at over usable comments; ``without_opener`` leaves out the root's speaker."""
    usable = rooted.where("not bad_speaker and not bad_text")
    said = usable.where("not is_root").select(F.col("speaker").alias("user_id"), "conversation_id", "ts")
    if without_opener:
        openers = usable.where("is_root").select(F.col("speaker").alias("user_id"), "conversation_id").distinct()
        said = said.join(openers, ["user_id", "conversation_id"], "left_anti")
    return splits.first_activity(said, ["user_id", "conversation_id"], "ts")


def thread_records(rooted: DataFrame, archive: str = "archive_no") -> DataFrame:
    """One row per archive and conversation: the first channel and title that are not empty, of the
    last usable root its id, speaker and text, and whether any root was unusable."""
    bad = F.col("bad_speaker") | F.col("bad_text")
    root = F.col("is_root") & ~bad
    first = lambda c: F.coalesce(F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("seq"))), F.lit("")).alias(c)
    last = lambda c, name: F.coalesce(F.max_by(F.when(root, F.col(c)), F.when(root, F.col("seq"))), F.lit("")).alias(name)
    flag = F.coalesce(F.max(F.col("is_root") & bad), F.lit(False)).alias("unusable_root")
    return rooted.groupBy(archive, "conversation_id").agg(
        first("channel"), first("title"), last("utterance_id", "root_id"), last("speaker", "root_speaker"), last("op_text", "op_text"), flag
    )


def merge_records(records: DataFrame, archive: str = "archive_no") -> DataFrame:
    """One row per conversation over all archives: of each field the first that is not empty; flags are or-ed."""
    fields = ["channel", "title", "root_id", "root_speaker", "op_text"]
    first = [F.coalesce(F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col(archive))), F.lit("")).alias(c) for c in fields]
    return records.groupBy("conversation_id").agg(*first, F.max("unusable_root").alias("unusable_root"))


def assembled(rooted: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """Numbered comments of each target user's thread: target_user, post_id, idx, comment_id, parent_id,
    user_id, text, label, is_target. targets: target_user, conversation_id.

    A comment that answers the conversation itself has no parent. Comments of the opener, if
    not the target's, are labelled as such; comments shown as context have no user.
    """
    said = rooted.where("not is_root")
    parent = F.when(F.coalesce("reply_to", F.lit("")) == F.col("conversation_id"), "").otherwise(F.coalesce("reply_to", F.lit("")))
    said = said.select(F.col("conversation_id").alias("post_id"), F.col("utterance_id").alias("comment_id"), parent.alias("parent_id"), "speaker", "text", "ts", "seq")
    numbered = threads.comments(said)
    roots = records.select(F.col("conversation_id").alias("post_id"), "root_speaker")
    wanted = targets.select("target_user", F.col("conversation_id").alias("post_id"))
    out = numbered.join(roots, "post_id", "left").join(wanted, "post_id")
    mine = ~F.col("context_only") & (F.col("user_id") == F.col("target_user"))
    opener = ~F.col("context_only") & ~mine & (F.col("user_id") == F.col("root_speaker"))
    label = F.when(opener, F.lit(OP_LABEL)).otherwise(F.col("label"))
    return out.select("target_user", "post_id", "idx", "comment_id", "parent_id", "user_id", "text", label.alias("label"), mine.alias("is_target"))


def labels(rows: DataFrame, column: str) -> DataFrame:
    """One row: the distinct values of a label column, sorted, without blanks."""
    return rows.where(F.trim(column) != "").agg(F.array_sort(F.collect_set(column)).alias("labels"))


def anonymised(comments: DataFrame, prefix: str = "corpus") -> DataFrame:
    """``assembled`` rows with dense ids for users, threads and comments (parents too).

    An unknown comment id becomes ''; the opener's comments get a blank user.
    """
    def named(columns: list[str], kind: str) -> DataFrame:
        values = comments.select(F.explode(F.array(*columns)).alias("_v"))
        return splits.sequential_ids(values, "_v", f"{prefix}_{kind}")

    users, posts, ids = named(["target_user", "user_id"], "user"), named(["post_id"], "thread"), named(["comment_id", "parent_id"], "comment")
    out = comments
    for column, names, lost in (("target_user", users, None), ("user_id", users, None), ("post_id", posts, None), ("comment_id", ids, ""), ("parent_id", ids, "")):
        out = out.join(names.select(F.col("_v").alias("_k"), F.col("anonymous_id").alias("_a")), F.col(column) == F.col("_k"), "left")
        out = out.withColumn(column, F.coalesce("_a", F.lit(lost) if lost is not None else F.col(column))).drop("_k", "_a")
    return out.withColumn("user_id", F.when(F.col("label") == OP_LABEL, F.lit("")).otherwise(F.col("user_id")))
