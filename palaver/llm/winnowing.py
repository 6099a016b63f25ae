"""Document fingerprints by winnowing (DataFrame operations only).

A text is a sequence of tokens: runs without white space, and each character of scripts
that are written without spaces (or, where asked for, all its characters). Each token is hashed
once. The hash of ``K`` successive tokens is a cyclic polynomial: tokens' hashes, rotated by
their distance to the run's end, joined by exclusive or, so a run's hash follows from that of
the run before by one rotation, the token that leaves and the one that enters. Arrays allow no
running state, so the same numbers are made by doubling: runs of 2m tokens from two of m, which
is log2(K) element-wise steps. Of each window of ``W`` successive hashes the least is picked,
the rightmost of equal ones, with its position (the number of its first token). So two texts
that share a passage of at least ``W + K - 1`` tokens share a pick, whatever stands around it,
and a match of picks is no shorter than ``K``.

Hash and negated position are joined in one number, so window minima with rightmost ties come
from log2(W) element-wise minima of an array and its shifted self. That is done in blocks of
windows, which bounds what is held besides a text's tokens, hashes and picks.

Defined results: a null text is empty; a text without tokens has no pick, one with fewer than
``K`` tokens is one run, one with fewer than ``W`` runs one window. Likeness is the Jaccard
similarity of the distinct hashes, 1 if both are empty. Rows are ordered by doc_id, null last,
then by the hash of the text; equal rows are each other's next. Texts hold up to 2**27 tokens.
Rows without a doc_id are dealt by that hash, so that many of them do not meet in one task.
Extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import row_hash

K, W = 4, 8
#: Windows of a block.
BLOCK = 4096
#: Scripts whose characters are tokens by themselves (fixed values).
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{UNSPACED}]|[^\s{UNSPACED}]+"
_POSITION_BITS = 27
_LAST = (1 << _POSITION_BITS) - 1
#: Rows of a bucket of neighbouring doc_ids, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 2000, 1 << 16


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, unit: str = "token") -> Column:
    """The tokens of ``text``, or its code points if ``unit`` is "character"."""
    text = F.coalesce(text, F.lit(""))
    if unit == "character":
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _turned(value: Column, by: int) -> Column:
    """64 bits rotated to the left."""
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _joined(left: Column, right: Column, at: int, size: int) -> Column:
    """Hashes of runs: those of ``at`` tokens in ``left``, each with the ``size`` tokens after it."""
    return F.zip_with(left, F.slice(right, at + 1, F.size(right)), lambda x, y: _turned(x, size).bitwiseXOR(y))


def rolled(hashes: Column, k: int) -> Column:
    """Cyclic polynomial of each ``k`` successive hashes; of all of them if they are fewer."""
    short = F.array(F.aggregate(hashes, F.lit(0).cast("bigint"), lambda had, h: _turned(had, 1).bitwiseXOR(h)))

    def runs(done: Column, length: int, power: Column, size: int) -> Column:
        """``done``: of ``length`` tokens, the lower bits of k so far; ``power``: of ``size``, a power of two."""
        if k & size:
            longer = _joined(power, done, size, length) if length else power
            length += size
        else:
            longer = done
        if length == k:
            return F.slice(longer, F.lit(1), F.greatest(F.size(hashes) - k + 1, F.lit(0)))
        grown = lambda d: _bind(_joined(power, power, size, size), lambda p: runs(d, length, p, 2 * size))
        return _bind(longer, grown) if k & size and length > size else grown(longer)

    return F.when(F.size(hashes) < k, short).otherwise(runs(hashes, 0, hashes, 1))


def _minima(keys: Column, width: int) -> Column:
    """Least of each ``width`` successive elements (a power of two), of fewer at the end."""

    def shifted(step: int):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.size(a)), lambda x, y: F.least(x, y))

    step = 1
    while step < width:
        keys = _bind(keys, shifted(step))
        step *= 2
    return keys


def _picked(keys: Column, w: int) -> Column:
    """Distinct least keys of the windows, block by block."""
    windows = F.greatest(F.size(keys) - w + 1, F.lit(1))
    starts = F.sequence(F.lit(0), windows - 1, F.lit(BLOCK))

    def block(first: Column) -> Column:
        part = F.slice(keys, first + 1, F.lit(BLOCK + w - 1))
        return _bind(part, lambda p: F.array_distinct(F.slice(_minima(p, w), F.lit(1), F.greatest(F.size(p) - w + 1, F.lit(1)))))

    return F.array_distinct(F.flatten(F.transform(starts, block)))


def picks(text: Column, k: int = K, w: int = W, unit: str = "token") -> Column:
    """struct<positions, hashes> of the picks of ``text``, in order."""
    # hash bits above, so that signed order is theirs; below, less for positions further right
    key = lambda h, i: F.shiftleft(h, _POSITION_BITS) + (F.lit(_LAST) - i)
    place = lambda p: (F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))).cast("int")

    def of(runs: Column) -> Column:
        chosen = _bind(F.transform(runs, key), lambda keys: F.transform(_picked(keys, w), place))
        found = _bind(chosen, lambda at: F.struct(at.alias("positions"), F.transform(at, lambda i: F.get(runs, i)).alias("hashes")))
        none = F.struct(F.array().cast("array<int>").alias("positions"), F.array().cast("array<bigint>").alias("hashes"))
        return F.when(F.size(runs) == 0, none).otherwise(found)

    hashes = F.transform(tokens(text, unit), lambda t: F.xxhash64(t))
    return _bind(hashes, lambda h: _bind(F.when(F.size(h) == 0, h).otherwise(rolled(h, k)), of))


def fingerprint(docs: DataFrame, *, k: int = K, w: int = W, unit: str = "token") -> DataFrame:
    """doc_id, n_chars, ``positions`` and ``hashes`` of the picks, of every row."""
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_chars"), picks(F.col("text"), k, w, unit).alias("_p")).select("doc_id", "n_chars", "_p.*")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays' distinct hashes; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def digest(picked: Column) -> Column:
    """A name of the fingerprint, equal for equal texts: a digest of its hashes and positions."""
    return F.sha2(F.to_json(picked), 256)


def _buckets(docs: DataFrame) -> Column:
    """Bucket of a row: neighbours in order share it, but at the cuts. Needs the text's hash ``th``.

    Cuts are quantiles of doc_id. Rows without one come last in order, so they take buckets
    below zero, by equal ranges of their hash.
    """
    rows, unnamed = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, -(-unnamed // BUCKET_ROWS))
    share = F.floor((F.col("th") / F.lit(2.0**64) + F.lit(0.5)) * parts)
    last = F.least(F.lit(parts - 1), F.greatest(F.lit(0), share)) - parts
    wanted = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    cuts: list[int] = []
    if wanted > 1:
        at = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", at, F.lit(10 * wanted)).alias("c")).first()["c"] or []))
    if not cuts:
        return F.when(F.col("doc_id").isNull(), last).otherwise(0).cast("int")
    width = max(2, round(len(cuts) ** 0.5))
    coarse = F.lit(cuts[::width])
    group = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id"))) - 1
    fine = F.size(F.filter(F.slice(F.lit(cuts), group * width + 1, F.lit(width)), lambda c: c <= F.col("doc_id")))
    inside = F.when(F.col("doc_id") < cuts[0], 0).otherwise(group * width + fine)
    return F.when(F.col("doc_id").isNull(), last).otherwise(inside).cast("int")


def with_next(docs: DataFrame, columns: dict | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next document by falling doc_id.

    After the last comes the first. Rows are dealt by buckets of neighbouring ids; the first
    row of a bucket is also sent, as a guest, to the bucket whose last row it follows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("th", row_hash()).withColumn("bucket", _buckets(docs))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")
    heads = own.groupBy("bucket").agg(F.max(order).alias("head"))
    up = F.lead("bucket").over(Window.orderBy("bucket"))  # a row per bucket
    lowest = F.min("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("bucket").alias("_b"), "head", F.coalesce(up, lowest).alias("_to"))
    meet = (F.col("bucket") == F.col("_b")) & (F.col("th") == F.col("head.th")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    guests = own.join(F.broadcast(heads), meet).select("doc_id", "text", F.col("_to").alias("bucket"), "th", F.lit(True).alias("guest"))
    dealt = own.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")
    for name, made in (columns or {}).items():
        dealt = dealt.withColumn(name, made)
    by = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("th"))
    for name in ["text", *(columns or {})]:
        dealt = dealt.withColumn(f"next_{name}", F.lead(name).over(by))
    return dealt.where("not guest").drop("bucket", "th", "guest")


def compare_with_edits(docs: DataFrame, *, k: int = K, w: int = W, unit: str = "token") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has its last floor(n / 2) code points replaced by the first as many of
    the next document's.
    """
    got = with_next(docs, {"picked": picks(F.col("text"), k, w, unit)})
    got = got.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    got = got.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    got = got.withColumn("edited_picked", picks(F.col("edited"), k, w, unit))
    hashes = {name: F.col(f"{name}.hashes") for name in ("picked", "edited_picked", "next_picked")}
    return got.select(
        "doc_id",
        "n_chars",
        "text",
        "edited",
        "picked",
        "edited_picked",
        likeness(hashes["picked"], hashes["edited_picked"]).alias("near_edited"),
        likeness(hashes["picked"], hashes["next_picked"]).alias("near_next"),
    )
