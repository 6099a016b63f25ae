"""Threads of comments: assembly, reply chains and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import context_label, context_text, redact, unusable_speaker, unusable_text
from palaver.storage import written

# Fixed value: the mark before a chain whose root is not known.
EARLIER = "[... earlier comments by other users ...]"


def comments(utterances: DataFrame) -> DataFrame:
    """Numbered comments of a thread.

    utterances: post_id, comment_id, parent_id, speaker, text, ts, seq. Unusable ones stay as
    context with placeholder text and label. Ties of time go by id, then by place of reading.
    """
    context = unusable_speaker("speaker") | unusable_text("text")
    out = utterances.withColumn("context_only", context)
    out = out.withColumn("label", F.when(context, context_label("speaker", "text")).otherwise(F.lit("")))
    out = out.withColumn("text", F.when(context, context_text("text")).otherwise(redact("text")))
    out = out.withColumn("user_id", F.when(context, F.lit("")).otherwise(F.col("speaker")))
    order = Window.partitionBy("post_id").orderBy("ts", "comment_id", "seq")
    return out.withColumn("idx", F.row_number().over(order) - 1).drop("speaker", "seq")


#: Threads up to this size are walked inside one row; in larger ones pointers are doubled by joins.
WALKED = 64


def reply_chains(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """post_id, comment_id, idx and ``chain``: ancestor ids from the root to the comment.

    edges: post_id, comment_id, parent_id, idx. ``wanted`` (post_id, idx): the comments whose
    chains are asked for (all, if not given). The walk stops at an unknown parent, and at an id
    met before (a cycle). Of equal ids in a thread the last is the one that others answer.
    """
    rows = chain_members(edges, wanted)
    ids = F.array_sort(F.collect_list(F.struct("depth", "ancestor")))
    return rows.groupBy("post_id", "comment_id", "idx").agg(F.transform(ids, lambda x: x["ancestor"]).alias("chain"))


def chain_members(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The same as rows: post_id, comment_id, idx, depth (0: the root), ancestor.

    A thread larger than ``WALKED`` never meets in one row: its pointers are doubled by joins
    on (thread, comment), as many rounds as the deepest chain's length has binary digits. Only
    the wanted comments' chains are spelt out.
    """
    edges = edges.select("post_id", "comment_id", "parent_id", F.col("idx").cast("int").alias("idx"))
    sizes, _ = written(edges.groupBy("post_id").agg(F.count(F.lit(1)).alias("_size")), "thread-sizes")
    most = sizes.agg(F.max("_size")).first()[0] or 0
    if wanted is not None:
        wanted = wanted.select("post_id", F.col("idx").cast("int").alias("idx")).distinct()
    small = edges if most <= WALKED else edges.join(sizes.where(F.col("_size") <= WALKED), "post_id", "left_semi")
    out = _walked(small, wanted)
    if most <= WALKED:
        return out
    large = edges.join(sizes.where(F.col("_size") > WALKED).select("post_id"), "post_id", "left_semi")
    return out.unionByName(_doubled(large, wanted, most))


def _walked(edges: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """``chain_members`` of small threads, each inside a row."""
    entry = F.struct("idx", F.col("comment_id").alias("id"), F.col("parent_id").alias("parent"))
    threads = edges.groupBy("post_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    threads = threads.withColumn("known", F.map_from_entries(F.transform(_unique("entries"), lambda e: F.struct(e["id"], e["parent"]))))
    if wanted is not None:
        chosen = wanted.groupBy("post_id").agg(F.collect_set("idx").alias("_chosen"))
        threads = threads.join(chosen, "post_id").withColumn("entries", F.filter("entries", lambda e: F.array_contains("_chosen", e["idx"])))

    def walk(start: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size("known"))
        state = F.struct(F.array(start["id"]).alias("chain"), start["parent"].alias("next"))

        def step(s: Column, _: Column) -> Column:
            name = F.coalesce(s["next"], F.lit(""))
            stop = (name == "") | ~F.map_contains_key(F.col("known"), name) | F.array_contains(s["chain"], name)
            on = F.struct(F.array_prepend(s["chain"], s["next"]).alias("chain"), F.try_element_at(F.col("known"), s["next"]).alias("next"))
            return F.when(stop, F.struct(s["chain"].alias("chain"), F.lit(None).cast("string").alias("next"))).otherwise(on)

        # no entry is known where no id is: the walk is the comment alone
        return F.when(F.size("known") == 0, F.array(start["id"])).otherwise(F.aggregate(steps, state, step)["chain"])

    chains = F.transform("entries", lambda e: F.struct(e["idx"].alias("idx"), e["id"].alias("comment_id"), walk(e).alias("chain")))
    each = threads.select("post_id", F.explode(chains).alias("c")).select("post_id", "c.comment_id", "c.idx", "c.chain")
    return each.select("post_id", "comment_id", "idx", F.posexplode("chain").alias("depth", "ancestor"))


def _unique(entries: str) -> Column:
    """Entries with an id, that no later entry has."""
    e = F.col(entries)
    later = lambda x, i: F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["id"].eqNullSafe(x["id"]))
    return F.filter(e, lambda x, i: (F.coalesce(x["id"], F.lit("")) != "") & ~later(x, i))


def _doubled(edges: DataFrame, wanted: DataFrame | None, most: int) -> DataFrame:
    """``chain_members`` by pointer doubling; ``most``: comments of the largest thread."""
    node = edges.where(F.coalesce("comment_id", F.lit("")) != "").groupBy("post_id", "comment_id").agg(F.max_by("parent_id", "idx").alias("up"), F.max("idx").alias("idx"))
    known = node.select("post_id", F.col("comment_id").alias("up"), F.lit(True).alias("_known"))
    real = node.join(known, ["post_id", "up"], "left")
    first, _ = written(real.select("post_id", F.col("comment_id").alias("id"), F.when(F.col("_known"), F.col("up")).alias("up"), "idx"), "chain-nodes")

    # up: the 2**k-th ancestor, null beyond the root; hops: the ancestors among the first 2**k
    state = first.select("post_id", "id", "up", F.col("up").isNotNull().cast("int").alias("hops"))
    levels, going = _levels(state, most)
    last = levels[-1]
    length = last.select("post_id", "id", (F.col("hops") + 1).alias("length"))
    if going:
        length = length.join(last.where("up is null").select("post_id", "id"), ["post_id", "id"], "left_semi").unionByName(_cyclic_lengths(first, levels))

    starts = edges if wanted is None else edges.join(wanted, ["post_id", "idx"], "left_semi")
    starts = starts.select("post_id", "idx", "comment_id", "parent_id")
    # of equal ids all but the last stand for themselves only; their walk goes on at their parent
    owners = first.select("post_id", F.col("id").alias("comment_id"), F.col("idx").alias("_owner"))
    starts = starts.join(owners, ["post_id", "comment_id"], "left")
    alone = F.coalesce(F.col("_owner") != F.col("idx"), F.lit(True))
    own = starts.where(~alone).select("post_id", "idx", "comment_id", F.col("comment_id").alias("id"), F.lit(0).alias("at"))
    up = starts.where(alone).select("post_id", "idx", "comment_id", F.col("parent_id").alias("id"), F.lit(1).alias("at"))
    begun = own.unionByName(up).join(length, ["post_id", "id"])
    begun = begun.withColumn("length", F.col("length") + F.col("at"))
    spelt = _spelt(begun, levels)
    # an unlisted walk that comes to its own id ends there
    met = spelt.where((F.col("at") > 0) & F.col("id").eqNullSafe(F.col("comment_id"))).groupBy("post_id", "idx").agg(F.min("at").alias("_cut"))
    itself = starts.where(alone).select("post_id", "idx", "comment_id", F.col("comment_id").alias("id"), F.lit(0).alias("at"))
    whole = spelt.select("post_id", "idx", "comment_id", "id", "at").join(met, ["post_id", "idx"], "left").where("_cut is null or at < _cut").drop("_cut")
    whole = whole.unionByName(itself)
    sizes = whole.groupBy("post_id", "idx").agg(F.max("at").alias("_top"))
    return whole.join(sizes, ["post_id", "idx"]).select("post_id", "comment_id", "idx", (F.col("_top") - F.col("at")).cast("int").alias("depth"), F.col("id").alias("ancestor"))


def _levels(state: DataFrame, most: int) -> tuple[list[DataFrame], int]:
    """Written tables (post_id, id, up, hops) for 1, 2, 4 ... steps, and how many pointers are left.

    They end when no pointer is left, or only those that lead into cycles and all of them end there.
    """
    open_ = F.col("up").isNotNull()
    state, going = written(state, "chain-level", open_)
    levels, steps, settled = [state], 1, False
    while going and steps <= most:
        on = state.select("post_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        moved = state.where(open_).join(on, ["post_id", "up"]).select("post_id", "id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"))
        state, left = written(moved.unionByName(state.where(~open_)), "chain-level", open_)
        levels.append(state)
        steps *= 2
        if left == going and not settled:
            # a longer chain would have an ancestor whose chain ended in this round: only cycles are left
            most, settled = state.where(open_).groupBy("post_id").count().agg(F.max("count")).first()[0], True
        going = left
    return levels, going


def _cyclic_lengths(first: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(post_id, id, length) of the chains that lead into cycles.

    After more steps than a thread has comments, pointers end exactly on the cycles' comments.
    """
    last = levels[-1]
    cycle = last.where("up is not null").select("post_id", F.col("up").alias("id")).distinct()
    cycle, _ = written(cycle, "chain-cycles")
    longest = cycle.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    # the least id of a cycle names it: least of 1, 2, 4 ... comments from each on
    name = cycle.withColumn("least", F.col("id"))
    for level in levels[: int(longest).bit_length()]:
        ahead = name.select("post_id", F.col("id").alias("up"), F.col("least").alias("_least"))
        name = name.join(level.select("post_id", "id", "up"), ["post_id", "id"]).join(ahead, ["post_id", "up"]).select("post_id", "id", F.least("least", "_least").alias("least"))
        name, _ = written(name, "chain-cycles")
    round_ = name.groupBy("post_id", "least").agg(F.count(F.lit(1)).alias("n"))
    sizes = name.join(round_, ["post_id", "least"]).select("post_id", "id", "n")
    # the other chains are known; with the cycles cut, these end at the comment where they meet one
    leading = first.join(last.where("up is not null").select("post_id", "id"), ["post_id", "id"], "left_semi")
    cut = leading.join(cycle.withColumn("_c", F.lit(True)), ["post_id", "id"], "left").select("post_id", "id", F.when(F.col("_c").isNull(), F.col("up")).alias("up"))
    ends = cut.withColumn("end", F.coalesce("up", "id")).withColumn("hops", F.col("up").isNotNull().cast("int"))
    open_ = F.col("up").isNotNull()
    ends, going = written(ends, "chain-ends", open_)
    while going:
        on = ends.select("post_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("end").alias("_end"), F.col("hops").alias("_hops"))
        moved = ends.where(open_).join(on, ["post_id", "up"])
        moved = moved.select("post_id", "id", F.col("_up").alias("up"), F.col("_end").alias("end"), (F.col("hops") + F.col("_hops")).alias("hops"))
        ends, going = written(moved.unionByName(ends.where(~open_)), "chain-ends", open_)
    met = sizes.select("post_id", F.col("id").alias("end"), "n")
    return ends.join(met, ["post_id", "end"]).select("post_id", "id", (F.col("hops") + F.col("n")).alias("length"))


def _spelt(begun: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (post_id, idx, comment_id, id, at, length) become one row for each comment of the chain.

    A row stands for the 2**k comments from ``id`` on; each level halves that, from the
    highest down, and leaves out what lies beyond the chain's length.
    """
    rows, _ = written(begun, "chain-starts")
    for k in range(len(levels) - 1, -1, -1):
        on = levels[k].where("up is not null").select("post_id", "id", "up")
        more = rows.where(F.col("at") + (1 << k) < F.col("length")).join(on, ["post_id", "id"])
        more = more.select("post_id", "idx", "comment_id", F.col("up").alias("id"), (F.col("at") + (1 << k)).alias("at"), "length")
        more, found = written(more, "chain-spelt")
        rows = rows.unionByName(more) if found else rows
    return rows


def last_target_chain(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Each thread's ids on the chain of its target user's last comment, numbered anew in the thread's order.

    targets: post_id, idx of the target user's comments. No other chain is spelt out.
    """
    last = targets.groupBy("post_id").agg(F.max("idx").cast("int").alias("idx"))
    chain = chain_members(edges, last).select("post_id", F.col("idx").alias("_leaf"), F.col("ancestor").alias("comment_id"), "depth")
    place = edges.groupBy("post_id", "comment_id").agg(F.max("idx").cast("int").alias("_at"))
    placed = chain.join(place, ["post_id", "comment_id"], "left")
    # the leaf is itself, whatever other comment has its id
    top = Window.partitionBy("post_id")
    placed = placed.withColumn("_at", F.when(F.col("depth") == F.max("depth").over(top), F.col("_leaf")).otherwise(F.col("_at")))
    order = F.row_number().over(top.orderBy("_at")) - 1
    return placed.select("post_id", order.alias("new_idx"), "comment_id")


def render_chains(shown: DataFrame) -> DataFrame:
    """post_id and ``rendered``: chains in order, each comment once, blocks by blank lines.

    shown: post_id, chain_no, depth, comment_id, line, open_root (the chain's root has an
    unknown parent). A chain whose first comment is new and open begins with a mark.
    """
    first = Window.partitionBy("post_id", "comment_id").orderBy("chain_no", "depth")
    new = shown.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "line"))), lambda x: x["line"]), "\n")
    opens = F.max((F.col("depth") == 0) & F.col("open_root"))
    blocks = new.groupBy("post_id", "chain_no").agg(body.alias("body"), opens.alias("open"))
    block = F.when(F.col("open"), F.concat(F.lit(EARLIER + "\n"), F.col("body"))).otherwise(F.col("body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain_no", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return blocks.groupBy("post_id").agg(joined.alias("rendered"))


def history_block(threads: DataFrame, user: str) -> DataFrame:
    """A user's earlier threads as numbered posts. threads: user, rank, opening, chains.

    Threads without chains are left out, yet keep their number.
    """
    post = F.concat(
        F.lit("\n<Post "), F.col("rank").cast("string"), F.lit(">\n[OTHER - OP]\n"), F.coalesce("opening", F.lit("")), F.lit("\n\n"), F.col("chains"),
        F.lit("\n</Post "), F.col("rank").cast("string"), F.lit(">"),
    )
    kept = threads.where(F.coalesce("chains", F.lit("")) != "")
    posts = F.transform(F.array_sort(F.collect_list(F.struct("rank", post.alias("p")))), lambda x: x["p"])
    # fixed value: the heading that results must carry
    head = F.lit("[USER HISTORY]\nBelow are [HUMAN]'s previous messages.\n")
    return kept.groupBy(user).agg(F.concat(head, F.array_join(posts, "\n")).alias("history"))


def usable_threads(comments_: DataFrame, openings: DataFrame) -> DataFrame:
    """Threads with an opening text, a usable root and one comment at least."""
    counts = comments_.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_comments"))
    return openings.where((F.trim("op_text") != "") & ~F.col("unusable_root")).join(counts, "post_id")


def recover_openings(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Opening texts of wanted posts: a full root wins over a title alone, then the first archive."""
    best = F.min_by("op_text", F.struct((~F.col("is_root")).alias("r"), "archive_ord"))
    return wanted.join(found.where(F.trim("op_text") != "").groupBy("post_id").agg(best.alias("op_text")), "post_id", "left")
