"""Language identification by hierarchical discrimination.

A text is hashed to counts of character 1- to 3-grams, root-scaled to unit length. Linear
support vector machines, one against the rest, choose the language family; inside a family
one-versus-one machines vote for the language (margins decide ties).

Defined results: a null text, and one without a letter, is ``und`` with score 0. Where nothing
could be learned every text is ``und``; with one learned language every other text gets it.
Each row is predicted by its text alone, so repeated rows, null ids and extra columns do no
harm. A text is read in blocks, so memory follows the longest text, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import small_batches

DIM = 4096
#: Bound on the learning rows of each language (expected size of the hash sample).
FIT_ROWS = 600
UNDETERMINED = "und"
#: Families of ISO 639-1 codes (fixed values). Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi ur bn pa gu mr ne si",
    "semitic": "ar he am mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_BLOCK = 1 << 16


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(text: str) -> np.ndarray:
    """Unit vector of the roots of hashed 1- to 3-gram counts, of the whole text."""
    counts = np.zeros(DIM, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), _BLOCK):  # blocks overlap by the longest gram less one
        codes = np.frombuffer(text[at : at + _BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(len(codes), _BLOCK)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(3):
            m = len(codes) - n
            if m <= 0:
                break
            gram = (gram[:m] + codes[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
            gram ^= gram >> np.uint32(15)
            counts += np.bincount((gram[:own] * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=DIM)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200, close: float = 2e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps. y: +1 or -1.

    Classes weigh alike however many rows they have. The last column of ``x`` is one, for
    the bias. Steps end when one moves the weights by less than ``close`` of their length.
    """
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * np.float32(c)
    step = np.float32(1.0 / (1.0 + 2 * float(weight.sum()) * 2))
    w = look = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        miss = np.maximum(np.float32(0), 1 - y * (x @ look))
        new = look - step * (look - 2 * ((weight * miss * y) @ x))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = new - w
        look = new + np.float32((t - 1) / t_new) * moved
        w, t = new, t_new
        if np.linalg.norm(moved) <= close * np.linalg.norm(w):
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    families: list[str]
    family_w: np.ndarray
    family_b: np.ndarray
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's share times the language's, by logistic margins."""
        margins = x @ self.family_w.T + self.family_b
        share = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        chosen = margins.argmax(axis=1)
        lang, score = [""] * len(x), share[np.arange(len(x)), chosen]
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            langs = self.langs[name]
            if len(rows) and len(langs) > 1:
                votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
                for i, j, w, b in self.pairs[name]:
                    m = x[rows] @ w + b
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    sums[:, i] += np.tanh(m)
                    sums[:, j] -= np.tanh(m)
                best = (votes + sums / (4 * len(langs))).argmax(axis=1)
                mean = sums[np.arange(len(rows)), best] / (len(langs) - 1)
                score[rows] *= 1 / (1 + np.exp(-4 * mean))
            else:
                best = np.zeros(len(rows), np.int64)
            for r, k in zip(rows, best):
                lang[r] = langs[k]
        return lang, np.clip(score, 0.0, 1.0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, vectors = [], []
        for text, name in zip(batch.column("text"), batch.column("lang").to_pylist()):
            text = text.as_py()
            if has_letter(text):
                lang.append(name)
                vectors.append(features(text).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(vectors, pa.binary())], names=["lang", "v"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn from rows (doc_id, text, lang) with a lang; a bounded hash sample of each language."""
    small_batches(docs.sparkSession, 1000)
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not sizes:
        return None
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    chosen = F.lit(False)
    for row in sizes:
        share = min(1.0, fit_rows / row["count"])
        chosen = chosen | ((F.col("lang") == row["lang"]) & (part < int(1_000_000 * share)))
    got = known.where(chosen).select("lang", "text").mapInArrow(_features_of, "lang string, v binary").toPandas()
    if got.empty:
        return None
    x = np.ones((len(got), DIM + 1), np.float32)
    x[:, :-1] = np.stack([np.frombuffer(v, np.float16) for v in got.v])
    order = np.lexsort((got.v.to_numpy(), got.lang.to_numpy()))  # the same model whatever the row order
    x, lang = x[order], got.lang.to_numpy()[order]
    by = {}
    for name in sorted(set(lang)):
        by.setdefault(family(name), []).append(name)
    families = sorted(by)
    group = np.array([family(name) for name in lang])
    if len(families) == 2:  # one machine serves both
        w, b = fit_svm(x, np.where(group == families[0], 1.0, -1.0))
        made = [(w, b), (-w, -b)]
    elif len(families) > 2:
        made = [fit_svm(x, np.where(group == f, 1.0, -1.0)) for f in families]
    else:
        made = [(np.zeros(DIM, np.float32), 0.0)]
    pairs = {}
    for f, langs in by.items():
        pairs[f] = []
        for (i, a), (j, b) in combinations(enumerate(langs), 2):
            rows = (lang == a) | (lang == b)
            pairs[f].append((i, j, *fit_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))))
    return Model(families, np.stack([m[0] for m in made]), np.array([m[1] for m in made]), by, pairs)


def identify(model: Model | None):
    """A column function: text -> struct<lang_pred, score>."""

    @F.pandas_udf("lang_pred string, score double")
    def identified(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            lang, score = np.full(len(batch), UNDETERMINED, dtype=object), np.zeros(len(batch))
            rows = [i for i, t in enumerate(batch) if model is not None and has_letter(t)]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                names, scores = model.predict(np.stack([features(batch.iloc[i]) for i in part]))
                lang[part], score[part] = names, scores
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return identified


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 by 4 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    small_batches(docs.sparkSession, 1000)
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(model)(F.col("text")).alias("_p"))
    return got.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
