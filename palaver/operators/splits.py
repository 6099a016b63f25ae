"""Users, their histories and reproducible splits.

Random choices are ranks of digests of ``seed:salt:id``, so a split depends neither on
partitioning nor on the order of rows. Windows run over narrow key projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_LOW, HISTORY_HIGH, SEED = 2, 6, 42


def hash_int(name: Column, width: int) -> Column:
    """The first 8 bytes of SHA-256, big-endian, modulo ``width``."""
    digest = F.sha2(name, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return ((high % width) * (2**32 % width) + low % width) % width


def history_count(user: Column, low: int = HISTORY_LOW, high: int = HISTORY_HIGH, seed: int = SEED) -> Column:
    """Threads of a user that are history, between ``low`` and ``high``."""
    return F.lit(low) + hash_int(F.concat(F.lit(f"{seed}:"), user.cast("string")), high - low + 1)


def tail_size(n: Column, fraction: float) -> Column:
    """Validation rows of n: int(n f), at least one if f and n allow, at most n - 1."""
    size = F.floor(n.cast("double") * fraction)
    if fraction > 0:
        size = F.when(n > 1, F.greatest(size, F.lit(1))).otherwise(size)
    return F.greatest(F.lit(0), F.least(size, n - 1)).cast("long")


def first_activity(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.min(at).alias("first_at"))


def eligible(threads: DataFrame, user: str, thread: str, least: int) -> DataFrame:
    """Users with at least ``least`` distinct threads, with their number."""
    return threads.groupBy(user).agg(F.count_distinct(thread).alias("n_threads")).where(F.col("n_threads") >= least)


def history_split(
    threads: DataFrame, user: str, order: list[str], *, low: int = HISTORY_LOW, high: int = HISTORY_HIGH, seed: int = SEED, fraction: float = 0.1
) -> DataFrame:
    """Each thread's rank and label: history, train or val. Users with n <= k + 1 threads drop out."""
    w = Window.partitionBy(user)
    ranked = threads.withColumn("thread_rank", F.row_number().over(w.orderBy(*order)).cast("long"))
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", history_count(F.col(user), low, high, seed).cast("long"))
    ranked = ranked.where(F.col("n") > F.col("k") + 1).withColumn("v", tail_size(F.col("n") - F.col("k"), fraction))
    label = F.when(F.col("thread_rank") <= F.col("k"), "history").when(F.col("thread_rank") <= F.col("n") - F.col("v"), "train").otherwise("val")
    return ranked.withColumn("label", label).drop("n", "v").withColumnRenamed("k", "history_count")


def user_tail_split(rows: DataFrame, user: str, order: list[str], fraction: float) -> DataFrame:
    """Each user's last rows are val, the others train; users with one row drop out."""
    w = Window.partitionBy(user)
    n = rows.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    n = n.withColumn("_r", F.row_number().over(w.orderBy(*order)))
    return n.withColumn("split", F.when(F.col("_r") > F.col("_n") - tail_size(F.col("_n"), fraction), "val").otherwise("train")).drop("_n", "_r")


#: Most buckets of a global order, and the values sampled to cut them (expected size, on the driver).
BUCKETS, SAMPLE, BUCKET_ROWS = 1024, 20_000, 200_000


def _cut_bucket(rows: DataFrame, by: str) -> Column:
    """Bucket of ``by``'s value: bucket numbers rise with the values. Cuts come from a hash sample."""
    n = rows.count()
    wanted = min(BUCKETS, n // BUCKET_ROWS)
    if wanted < 2:
        return F.lit(0)
    share = F.pmod(F.xxhash64(by), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / n))
    seen = sorted({r[0] for r in rows.where(share & F.col(by).isNotNull()).select(by).collect()})
    cuts = sorted({seen[len(seen) * i // wanted] for i in range(1, wanted)}) if seen else []
    if not cuts:
        return F.lit(0)
    width = max(2, round(len(cuts) ** 0.5))
    group = F.size(F.filter(F.array(*map(F.lit, cuts[::width])), lambda c: c <= F.col(by))) - 1
    fine = F.size(F.filter(F.slice(F.array(*map(F.lit, cuts)), group * width + 1, F.lit(width)), lambda c: c <= F.col(by)))
    return F.when(F.col(by).isNull() | (F.col(by) < cuts[0]), 0).otherwise(group * width + fine)


def globally_numbered(rows: DataFrame, name: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """``name``: the 0-based place of each row in the order of the columns ``order``.

    Rows are numbered within buckets of the first column (``bucket``, where its cuts are
    known), and the counts of the buckets before are added: at most 4,096 rows of counts
    meet in one task, never the rows themselves. Rows that tie in all of ``order`` share it by chance.
    """
    marked = rows.withColumn("_b", (_cut_bucket(rows, order[0]) if bucket is None else bucket).cast("int"))
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))
    inside = marked.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return inside.join(F.broadcast(before), "_b").withColumn(name, (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_b", "_i", "_before")


def digest_numbered(rows: DataFrame, name: str, digest: Column, key: str) -> DataFrame:
    """``globally_numbered`` by a hexadecimal digest, then ``key``; a digest's first digits are its bucket."""
    marked = rows.withColumn("_d", digest)
    return globally_numbered(marked, name, ["_d", key], F.conv(F.substring("_d", 1, 3), 16, 10)).drop("_d")


def user_rank(users: DataFrame, user: str, salt: str, seed: int = SEED) -> DataFrame:
    """Users in an order that is random but fixed: rank of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{salt}:"), F.col(user).cast("string")), 256)
    ranked = digest_numbered(users.select(user).distinct(), "user_rank", digest, user)
    return ranked.withColumn("user_rank", F.col("user_rank") + 1)


def fraction_cut(users: DataFrame, user: str, fraction: float, salt: str, *, even: bool = True, seed: int = SEED) -> DataFrame:
    """Users whose rank falls in the first fraction; the cut is round-half-even or floor."""
    ranked = user_rank(users, user, salt, seed)
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.bround(F.col("_n").cast("double") * fraction) if even else F.floor(F.col("_n").cast("double") * fraction)
    return ranked.crossJoin(F.broadcast(n)).withColumn("chosen", F.col("user_rank") <= cut).drop("_n")


def heldout_conversations(conversations: DataFrame, user: str, thread: str, share: float, salt: str = "conv", seed: int = SEED) -> DataFrame:
    """A held-out user's conversations: the first max(1, int(share m)) are val (all but one at most), the rest test."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{salt}:"), F.col(user).cast("string"), F.lit(":"), F.col(thread).cast("string")), 256)
    w = Window.partitionBy(user)
    out = conversations.select(user, thread).distinct()
    out = out.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(digest, thread)))
    e = F.greatest(F.lit(1), F.floor(F.col("_m") * F.lit(float(share))))
    e = F.when(F.col("_m") > 1, F.least(e, F.col("_m") - 1)).otherwise(e)
    return out.withColumn("split", F.when(F.col("_r") <= e, "val").otherwise("test")).drop("_m", "_r")


def user_roles(conversations: DataFrame, user: str, thread: str, *, least: int, heldout: float, offset: int = 0, most_users: int | None = None, seed: int = SEED) -> DataFrame:
    """user, user_rank and ``role`` (heldout or train) of the users that are used.

    Users with ``least`` distinct threads or more stand in their random order; the first int(heldout n)
    are held out. Of the rest the first ``offset`` are skipped, then at most ``most_users`` are taken.
    """
    if least < 1 or not 0 <= heldout < 1 or offset < 0 or (most_users is not None and most_users < 1):
        raise ValueError("least and most_users must be positive, offset not negative, and heldout at least 0 and below 1")
    users = eligible(conversations, user, thread, least).select(user)
    ranked = fraction_cut(users, user, heldout, "heldout", even=False, seed=seed)
    held = ranked.agg(F.count_if("chosen").alias("_held"))
    ranked = ranked.crossJoin(F.broadcast(held))  # one row
    place = F.col("user_rank") - F.col("_held") - offset
    used = place > 0 if most_users is None else (place > 0) & (place <= most_users)
    role = F.when(F.col("chosen"), "heldout").when(used, "train")
    return ranked.select(user, "user_rank", role.alias("role")).where("role is not null")


def role_conversations(
    conversations: DataFrame, user: str, thread: str, roles: DataFrame, *, share: float, low: int = HISTORY_LOW, high: int = HISTORY_HIGH, seed: int = SEED
) -> DataFrame:
    """user, thread, role, ``place`` (from 1, in the user's random order) and ``split`` of the users of ``roles``.

    The first threads, a random number from low to high but one fewer than all at most (and one at least),
    are history. The others of a train user are train; of a held-out user's the first max(1, int(share m)) of m are val
    (all but one at most), the rest test.
    """
    if not 0 <= share < 1 or low < 1 or high < low:
        raise ValueError("share must be at least 0 and below 1, low at least 1 and high no less")
    rows = conversations.select(user, thread).distinct().join(roles.select(user, "role"), user)
    digest = F.sha2(F.concat(F.lit(f"{seed}:conv:"), F.col(user).cast("string"), F.lit(":"), F.col(thread).cast("string")), 256)
    w = Window.partitionBy(user)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(digest, thread)).cast("long"))
    k = F.least(history_count(F.col(user), low, high, seed), F.greatest(F.lit(1), F.col("_n") - 1))
    rows = rows.withColumn("_k", k.cast("long")).withColumn("_m", F.col("_n") - F.col("_k"))
    e = F.greatest(F.lit(1), F.floor(F.col("_m") * F.lit(float(share))))
    e = F.when(F.col("_m") > 1, F.least(e, F.col("_m") - 1)).otherwise(e)
    later = F.when(F.col("role") == "train", "train").when(F.col("place") <= F.col("_k") + e, "val").otherwise("test")
    return rows.withColumn("split", F.when(F.col("place") <= F.col("_k"), "history").otherwise(later)).drop("_n", "_k", "_m")


def without(rows: DataFrame, users: DataFrame, user: str) -> DataFrame:
    return rows.join(users.select(user), user, "left_anti")


def only(rows: DataFrame, users: DataFrame, user: str) -> DataFrame:
    return rows.join(users.select(user), user, "left_semi")


def overlap(left: DataFrame, right: DataFrame, user: str) -> DataFrame:
    """n_left, n_right and n_both distinct users."""
    a = left.select(user).distinct().withColumn("_l", F.lit(1))
    b = right.select(user).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, user, "full")
    return both.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))


def number_rows(rows: DataFrame, user: str, split: str, order: list[str]) -> DataFrame:
    """``prompt_idx``: one counter over users in order, each user's splits in turn.

    Counts per user are summed first, in buckets of users, and only the buckets' sums meet in one task.
    """
    within = rows.withColumn("_i", F.row_number().over(Window.partitionBy(user).orderBy(split, *order)))
    sizes = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_c")).withColumn("_u", _cut_bucket(rows.select(user).distinct(), user).cast("int"))
    ahead = sizes.groupBy("_u").agg(F.sum("_c").alias("_t"))
    ahead = ahead.select("_u", (F.sum("_t").over(Window.orderBy("_u")) - F.col("_t")).alias("_ahead"))
    own = F.sum("_c").over(Window.partitionBy("_u").orderBy(user)) - F.col("_c")
    before = sizes.withColumn("_own", own).join(F.broadcast(ahead), "_u").select(user, (F.col("_ahead") + F.col("_own")).alias("_before"))
    return within.join(before, user).withColumn("prompt_idx", (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_i", "_before")


def slice_users(users: DataFrame, user: str, offset: int, limit: int) -> DataFrame:
    """Users offset+1 .. offset+limit in id order; an offset beyond the end is an error."""
    ranked = globally_numbered(users.select(user).distinct(), "_r", [user])
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))
    checked = ranked.crossJoin(F.broadcast(total)).where(F.when(F.col("_n") < offset, F.raise_error(F.lit("offset is beyond the last user")).cast("boolean")).otherwise(F.lit(True)))
    return checked.where((F.col("_r") >= offset) & (F.col("_r") < offset + limit)).select(user)


def sequential_ids(values: DataFrame, column: str, prefix: str, width: int = 6) -> DataFrame:
    """Each distinct non-blank value with a dense zero-padded id by sorted order."""
    distinct = values.select(column).where(F.trim(F.col(column).cast("string")) != "").distinct()
    ranked = globally_numbered(distinct, "_r", [column])
    # a number wider than the padding keeps all its digits
    number = F.when(F.length(F.col("_r").cast("string")) >= width, F.col("_r").cast("string")).otherwise(F.lpad(F.col("_r").cast("string"), width, "0"))
    return ranked.select(column, F.concat(F.lit(f"{prefix}_"), number).alias("anonymous_id"))


def first_non_blank(rows: DataFrame, user: str, value: str, order: list[str]) -> DataFrame:
    """Each user's first non-blank value."""
    return rows.where(F.trim(F.col(value)) != "").groupBy(user).agg(F.min_by(value, F.struct(*order)).alias(value))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``shuffle_ord``: a fixed random order of rows by a digest of their key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return digest_numbered(rows, "shuffle_ord", digest, key).withColumn("shuffle_ord", F.col("shuffle_ord") + 1)


def include_exclude(rows: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Membership by lower-cased trimmed value. An empty include list keeps nothing."""
    name = F.lower(F.trim(F.col(column)))
    if include is not None:
        rows = rows.where(name.isin([x.strip().lower() for x in include]) if include else F.lit(False))
    if exclude:
        rows = rows.where(~F.coalesce(name.isin([x.strip().lower() for x in exclude]), F.lit(False)))
    return rows
