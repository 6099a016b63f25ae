"""Copied passages between a response and its sources, by seeds that are extended on diagonals.

Words are hashed; seeds are minimizers: of each ``n`` successive words the least hash of
its short grams, the leftmost of equal ones. Texts that share ``n`` words in a row share the
seed of that stretch, so about a third of the positions stands for all of them, as numbers.

Responses' seeds that no source has are left out before anything is shuffled: up to
``BROADCAST_SEEDS`` seeds of the sources are broadcast; of more, a bitmap of ``FILTER_BITS`` bits is
(16 MB, whatever the sources' size), and what passes it is joined by a shuffle, seeds that are frequent in
the responses dealt over ``SALTS`` parts each. A match names a diagonal (response place less
source place) of a pair; there the words themselves are compared, and stretches of ``n`` equal
words or more are the runs. No word is joined to a match before it is known to be on a diagonal.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import folded_words
from palaver.storage import written

#: Most source seeds that are broadcast (a hash, a position and the keys: under 100 bytes each).
BROADCAST_SEEDS = 300_000
#: Bits of the filter that takes their place beyond.
FILTER_BITS = 1 << 27
#: Parts that a frequent seed is dealt over; of the filtered seeds one in so many makes it frequent.
SALTS, FREQUENT = 32, 1000
#: Most responses with a match whose keys are broadcast to pick them (under 100 bytes each).
BROADCAST_KEYS = 200_000


def seeds(rows: DataFrame, keys: list[str], words: Column, n: int, at: str) -> DataFrame:
    """keys, position (from 0) and ``seed`` of the minimizers of every n words."""
    k = (n + 1) // 2
    window = n - k + 1
    # short texts are left out by guards: a filter would be pushed down and cut the words twice
    hashed = rows.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    gram = lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(k)])
    grams = hashed.select(*keys, F.when(F.size("_h") >= n, F.transform(F.sequence(F.lit(0), F.size("_h") - k), gram)).alias("_g"))

    # by single elements: a slice copies the whole array before it cuts
    at_least = lambda i: functools.reduce(F.least, [F.get("_g", i + j) for j in range(window)])
    grams = grams.withColumn("_m", F.when(F.col("_g").isNotNull(), F.transform(F.sequence(F.lit(0), F.size("_g") - window), at_least)))

    def pick(i: Column) -> Column:
        least, out = F.get("_m", i), i + window - 1
        for j in reversed(range(window - 1)):
            out = F.when(F.get("_g", i + j) == least, i + j).otherwise(out)
        return out

    picked = F.when(F.col("_m").isNotNull(), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_m") - 1), pick)))
    each = grams.select(*keys, F.explode(F.transform(picked, lambda p: F.struct(p.alias(at), F.get("_g", p).alias("seed")))).alias("_s"))
    return each.select(*keys, f"_s.{at}", "_s.seed")


def _filtered(found: DataFrame, source_seeds: DataFrame) -> DataFrame:
    """``found`` without most seeds that no source has, by a broadcast bitmap of a fixed size."""
    bit = F.pmod("seed", F.lit(FILTER_BITS))
    maps = source_seeds.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    joined = found.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_bucket")
    return joined.where(held).drop("_bit", "_bucket", "_map")


def _matched(r: DataFrame, s: DataFrame, response_key: list[str], on: list[str]) -> DataFrame:
    """Seeds of responses with the equal ones of sources, with no hot task for a frequent seed."""
    s, number = written(s, "copy-seeds")
    if number <= BROADCAST_SEEDS:
        return r.join(F.broadcast(s), ["seed", *on])
    r, total = written(_filtered(r, s), "copy-filtered")
    # a seed that has one in FREQUENT of all matches or more: there are no more than FREQUENT of them
    hot = r.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(total // FREQUENT, SALTS)).select("seed", F.lit(SALTS).alias("_salts"))
    salted = lambda df: df.join(F.broadcast(hot), "seed", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    dealt = salted(r).withColumn("_salt", F.pmod(F.xxhash64(*response_key), F.col("_salts")).cast("int")).drop("_salts")
    spread = salted(s).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(spread, ["seed", "_salt", *on]).drop("_salt")


def runs(responses: DataFrame, sources: DataFrame, response_key: list[str], source_key: list[str], on: list[str], n: int) -> DataFrame:
    """Maximal runs: keys, response_start, response_end (exclusive), source_start, tokens.

    ``on``: columns that a response shares with the sources it is compared with (may be none).
    Both tables have a ``words`` array. A response_key or source_key names one row. Null words
    are an empty text.
    """
    on_r, on_s = [c for c in on if c not in response_key], [c for c in on if c not in source_key]
    r_keys, s_keys = [*response_key, *on_r], [*source_key, *on_s]
    keys = list(dict.fromkeys([*r_keys, *s_keys]))
    met = _matched(seeds(responses, r_keys, F.col("words"), n, "ri"), seeds(sources, s_keys, F.col("words"), n, "si"), r_keys, on)
    lines = met.groupBy(*keys, (F.col("ri") - F.col("si")).alias("d")).agg(F.lit(1).alias("_one")).drop("_one")
    lines, _ = written(lines, "copy-lines")
    wanted = lines.select(*r_keys).distinct()
    chosen, number = written(wanted, "copy-chosen")
    texts = responses.select(*r_keys, F.col("words").alias("_r")).join(F.broadcast(chosen) if number <= BROADCAST_KEYS else chosen, r_keys, "left_semi")
    placed = lines.join(sources.select(*s_keys, F.col("words").alias("_s")), s_keys).join(texts, r_keys)
    # the stretch of both texts that lies on the diagonal
    begin = F.greatest(F.lit(0), F.col("d"))
    size = F.least(F.size("_r"), F.size("_s") + F.col("d")) - begin
    same = F.zip_with(F.slice("_r", begin + 1, size), F.slice("_s", begin - F.col("d") + 1, size), operator.eq)
    placed = placed.select(*keys, "d", begin.alias("_begin"), same.alias("_same"))
    apart = F.filter(F.sequence(F.lit(0), F.size("_same") - 1), lambda i: ~F.get("_same", i))
    placed = placed.withColumn("_apart", F.concat(F.array(F.lit(-1)), apart, F.array(F.size("_same"))))
    between = F.transform(F.sequence(F.lit(1), F.size("_apart") - 1), lambda j: F.struct((F.get("_apart", j - 1) + 1).alias("at"), (F.get("_apart", j) - F.get("_apart", j - 1) - 1).alias("tokens")))
    found = placed.select(*keys, "d", "_begin", F.explode(F.filter(between, lambda x: x["tokens"] >= n)).alias("_x"))
    start = F.col("_begin") + F.col("_x.at")
    return found.select(
        *keys,
        start.cast("long").alias("response_start"),
        (start + F.col("_x.tokens")).cast("long").alias("response_end"),
        (start - F.col("d")).cast("long").alias("source_start"),
        F.col("_x.tokens").cast("long").alias("tokens"),
    )


def longest(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.max("tokens").alias("longest"))


def greedy(found: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Up to k runs with disjoint response spans, longest first, then leftmost: keys and ``chosen``.

    ``chosen`` has structs o (minus the tokens), s, e and, where there is one, source_rank, in
    the order of choice. Each of the k rounds takes the best span of each response and leaves
    out what it meets, so no response's runs are gathered.
    """
    rank = ["source_rank"] if "source_rank" in found.columns else []
    spans = found.groupBy(*keys, F.col("response_start").alias("s"), F.col("response_end").alias("e"), *rank).agg((-F.max("tokens")).alias("o"))
    left, number = written(spans, "copy-spans")
    rounds = []
    for turn in range(k):
        best = left.groupBy(*keys).agg(F.min(F.struct("o", "s", "e", *rank)).alias("_best"))
        best, number = written(best, "copy-best")
        rounds.append(best.withColumn("_turn", F.lit(turn)))
        if not number or turn + 1 == k:
            break
        clash = (F.col("s") < F.col("_best.e")) & (F.col("_best.s") < F.col("e"))
        left = left.join(best, keys).where(~clash).drop("_best")
    every = functools.reduce(DataFrame.unionByName, rounds)
    listed = every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_turn", "_best"))).alias("_m"))  # k at most
    return listed.select(*keys, F.transform("_m", lambda x: x["_best"]).alias("chosen"))


def leaks(found: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Keys with a run of ``threshold`` tokens or more."""
    return longest(found, keys).withColumn("leaks", F.col("longest") >= threshold)


def watchlist(matches: Column) -> Column:
    """Text for a judge: a line per excerpt, or a fixed sentence."""
    lines = F.transform(matches, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m))
    return F.when(F.size(matches) > 0, F.array_join(lines, "\n")).otherwise(F.lit("No copied passage was found."))


def with_words(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("words", folded_words(text))
