"""Quality rules: boosted trees over document statistics.

Statistics of a text (words are runs of characters other than ASCII white space)
feed two verdicts: fixed base limits, and gradient-boosted trees fitted on labelled
documents. The trees are flattened into numpy node arrays, so a batch of documents
is scored by indexing alone. On chosen features the score is monotone.

Defined results: a null or empty text has no words and fails the base limits.
Without usable labels (none, or one class only) no tree is fitted and the base
limits alone decide. Rows are judged one by one, so repeated rows, null ids, ties
and extra columns change nothing. Very long texts need memory in proportion to
one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import small_batches

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Bound on the labelled documents that the trees are fitted on (expected size of the hash sample).
FIT_ROWS = 20_000
#: Share of the labelled good documents that the fitted threshold may cost.
GOOD_LOSS = 0.001
#: One in so many labelled documents is kept from the trees and sets the threshold.
HELD_OUT = 5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: feature -> direction of the score as the feature grows (0: free)
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "punct_per_word": 0,
    "distinct_share": 0,
    "top_word_share": -1,
    "longest_word": 0,
    "words_per_line": 0,
    "stop_end_share": 0,
}
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(ids: np.ndarray, k: int = WINDOW) -> int:
    """Positions covered by k-word windows that occur twice or more (exact)."""
    n = len(ids)
    if n <= k:
        return 0
    rank = ids.astype(np.int64)
    width = 1
    while width < k:  # rank of windows of `width` words, widened until k
        step = min(width, k - width)
        pair = rank[: len(rank) - step] * np.int64(n + 1) + rank[step:]
        rank = pd.factorize(pair)[0].astype(np.int64)
        width += step
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(again)] += again
    edge[k : k + len(again)] -= again
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at ASCII white space only
    n_words = len(words)
    white = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    word_chars = len(text) - white
    n_symbols = len(_SYMBOLS.findall(text))
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    if n_words:
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        n_repeat = repeated_window_words(codes)
        top = int(np.bincount(codes).max()) / n_words
        n_distinct, longest = len(distinct), max(map(len, distinct))
    else:
        n_repeat = top = n_distinct = longest = 0
    per = 1.0 / max(n_words, 1)
    chars = 1.0 / max(word_chars, 1)
    b = np.frombuffer(raw, dtype=np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    digit = int(((b >= 48) & (b <= 57)).sum())
    punct = sum(text.count(c) for c in ".,;:!?")
    features = (
        float(np.log1p(n_words)),
        word_chars * per,
        n_symbols * per,
        n_dup / max(n_lines, 1),
        n_repeat * per,
        upper * chars,
        digit * chars,
        punct * per,
        n_distinct * per,
        top,
        float(min(longest, 1000)),
        n_words / max(n_lines, 1),
        text.count(".") / max(n_lines, 1),
    )
    return (n_words, word_chars, n_symbols, n_dup, n_repeat), features


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


@dataclass
class Trees:
    """Complete binary trees as node arrays: [tree, node], and leaves [tree, leaf]."""

    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    bias: float
    depth: int
    threshold: float = 0.0
    names: tuple[str, ...] = field(default=tuple(FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good."""
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.split[t, node])
            out += self.leaf[t, node - (2**self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    *,
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    min_rows: int = 10,
    ridge: float = 1.0,
    monotone: tuple[int, ...] = tuple(FEATURES.values()),
) -> Trees | None:
    """Histogram gradient boosting of log-loss; None where one class is missing.

    A constrained split must order its children's values; what lies below a
    constrained split is held on its side of the children's middle.
    """
    good = float(y.mean()) if len(y) else 0.0
    if not 0.0 < good < 1.0:
        return None
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    inner = 2**depth - 1
    feature = np.zeros((n_trees, inner), dtype=np.int64)
    split = np.full((n_trees, inner), np.inf)
    leaf = np.zeros((n_trees, 2**depth))
    bias = float(np.log(good / (1 - good)))
    raw = np.full(n, bias)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            lo, hi = low[at], high[at]
            best = (0.0, None)
            if len(rows) >= 2 * min_rows:
                g, h = grad[rows], hess[rows]
                total_g, total_h = g.sum(), h.sum()
                for j in range(d):
                    if not len(edges[j]):
                        continue
                    b = binned[rows, j]
                    size = len(edges[j]) + 1
                    gl = np.cumsum(np.bincount(b, g, size))[:-1]
                    hl = np.cumsum(np.bincount(b, h, size))[:-1]
                    cl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    wl = np.clip(gl / (hl + ridge), lo, hi)
                    wr = np.clip(gr / (hr + ridge), lo, hi)
                    gain = 2 * (gl * wl + gr * wr) - (hl + ridge) * wl**2 - (hr + ridge) * wr**2
                    gain = gain - total_g**2 / (total_h + ridge)
                    ok = (cl >= min_rows) & (len(rows) - cl >= min_rows) & (monotone[j] * (wr - wl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    i = int(gain.argmax())
                    if gain[i] > best[0] + 1e-9:
                        best = (float(gain[i]), (j, float(edges[j][i]), float(wl[i]), float(wr[i])))
            left, right = 2 * at + 1, 2 * at + 2
            low[left] = low[right] = lo
            high[left] = high[right] = hi
            if best[1]:
                j, cut, wl, wr = best[1]
                feature[t, at], split[t, at] = j, cut
                middle = (wl + wr) / 2
                if monotone[j] > 0:
                    high[left], low[right] = middle, middle
                elif monotone[j] < 0:
                    low[left], high[right] = middle, middle
                node[rows] = np.where(x[rows, j] > cut, right, left)
            else:
                node[rows] = left
        for k in range(2**depth):
            at = inner + k
            rows = node == at
            w = grad[rows].sum() / (hess[rows].sum() + ridge)
            leaf[t, k] = rate * float(np.clip(w, low[at], high[at]))
        raw += leaf[t, node - inner]
    return set_threshold(Trees(feature, split, leaf, bias, depth), x, y)


def set_threshold(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """The threshold that costs ``GOOD_LOSS`` of the good rows given, 0.5 at most."""
    model.threshold = float(min(0.5, np.quantile(model.score(x)[y > 0], GOOD_LOSS)))
    return model


_STATS = T.StructType(
    [T.StructField(c, T.LongType()) for c in BASE_COLUMNS] + [T.StructField("features", T.ArrayType(T.DoubleType()))]
)
_JUDGED = T.StructType(
    [T.StructField(c, T.LongType()) for c in BASE_COLUMNS]
    + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


@F.pandas_udf(_STATS)
def _statistics_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = [statistics(t) for t in batch]
        out = pd.DataFrame([r[0] for r in rows], columns=list(BASE_COLUMNS))
        out["features"] = [list(r[1]) for r in rows]
        yield out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Fit on a hash sample of about ``fit_rows`` labelled documents at most.

    The trees learn from four in five of them, by a hash of the id; the others set the
    threshold (all do, where none of the others is good).
    """
    small_batches(docs.sparkSession, 1000)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, fit_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # about FIT_ROWS ids; the texts stay where they are
        .select(F.col("doc_id"), "quality", _statistics_udf("text").alias("s"))
        .select("doc_id", "quality", "s.n_words", "s.n_repeat_words", "s.features", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)).alias("part"))
        .orderBy("doc_id")
        .toPandas()
    )
    if rows.empty:
        return None
    rows = rows[~base_failed(rows.n_words.to_numpy(), rows.n_repeat_words.to_numpy())]
    if rows.empty:
        return None
    x, y = np.array(rows.features.tolist(), dtype=float), (rows.quality > 0).to_numpy().astype(float)
    held = (rows.part == 0).to_numpy()
    model = fit_trees(x[~held], y[~held]) if not held.all() else None
    if model is not None and (y[held] > 0).any():
        set_threshold(model, x[held], y[held])
    return model


def judge(model: Trees | None):
    """A column function: text -> struct of statistics, base_failed, score and kept."""

    @F.pandas_udf(_JUDGED)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [statistics(t) for t in batch]
            out = pd.DataFrame([r[0] for r in rows], columns=list(BASE_COLUMNS), dtype="int64")
            bad = base_failed(out.n_words.to_numpy(), out.n_repeat_words.to_numpy())
            if model is not None and rows:
                score = model.score(np.array([r[1] for r in rows], dtype=float))
                kept = ~bad & (score >= model.threshold)
            else:
                score = np.where(bad, 0.0, 1.0)
                kept = ~bad
            out["base_failed"], out["score"], out["kept"] = bad, score, kept
            yield out

    return judged


def score_documents(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept, for every row of ``docs``."""
    small_batches(docs.sparkSession, 1000)
    got = docs.select("doc_id", judge(model)(F.col("text")).alias("_judged"))
    return got.select("doc_id", "_judged.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Rows are judged one by one: repeated rows stay or go together, null texts go.
    """
    model = fit(docs, labels)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    marked = packed.withColumn("_judged", judge(model)(F.col("_row.text")))
    return marked.where("_judged.kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
