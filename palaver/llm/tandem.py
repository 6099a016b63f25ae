"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye (2004).

A run is a stretch of words with smallest period q (words q apart are identical) that no
neighbouring word extends. Texts are looked at a group at a time in a task, in arrays:

1. ``Factors`` names every stretch of 2**k words by its rank. The highest names are the
   suffix array; names stand in for the suffix tree: a locus is an interval of suffixes,
   and a suffix link leads from the locus of a suffix to that of the next position.
2. Lempel-Ziv blocks, from the longest previous factor of each position. Squares (two equal
   stretches in a row) whose leftmost centre lies in a block are found at the block's borders:
   for each period up to the sizes of the block and the next, by the common extensions to both
   sides. They cover the vocabulary: every square is a rotation of one found.
3. Walks complete the vocabulary. The next rotation is the square one word on, if the text
   goes on so; else the suffix link leads to the locus of all but its first word, and a branch
   with that word, searched among the suffixes of that locus, is the next rotation.
4. Each square of the vocabulary is located: the suffixes that begin with it. Starts of
   one period that follow one another are one run.

Only squares with a primitive root are kept, so q is the smallest period of its run. A run of
``exponent`` periods makes a previous factor of length - q words; texts without a repeated
stretch of four words have none and leave after the second naming.

Defined results: words are runs of other characters than ASCII white space. A null or empty text has no run.
Each row is looked at by itself, repeated ones and those with a null key too; other columns
pass through, whatever their names. An empty table gives no row. A text is held whole by its
task, with about 80 bytes a word while its runs are sought.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs have so many words and so many periods at least.
WORDS, EXPONENT = 6, 4
#: Words of the texts that are looked at together.
GROUP = 1 << 18

Edit = Callable[[object, list[bytes]], list[bytes]]


def _named(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of dense symbols (of equal symbols: the first place in sorted order), and the positions of those that recur."""
    size = np.bincount(symbols)
    return (np.cumsum(size) - size)[symbols], np.flatnonzero(size[symbols] > 1)


def _refined(rank: np.ndarray, open_: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of stretches of 2 * ``step`` words from those of ``step`` words, and the positions of those that recur.

    ``open_``: positions whose stretch of ``step`` words recurs; the ranks of others are final.
    """
    key = rank[open_] * len(rank) + rank[open_ + step]
    order = np.argsort(key)
    at, key = open_[order], key[order]
    group = rank[at]
    of_group = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    first = np.repeat(of_group, np.diff(np.append(of_group, len(at))))
    size = np.diff(np.append(new, len(at)))
    out = rank.copy()
    out[at] = group + np.repeat(new, size) - first
    return out, np.sort(at[np.repeat(size, size) > 1])


class Factors:
    """Ranks of all stretches of 2**k words of texts in a row, each with an end mark of its own.

    ``symbols``: dense, no symbol in two texts. Stretches that hold an end mark are alone.
    """

    def __init__(self, symbols: np.ndarray):
        rank, open_ = _named(symbols)
        names = [rank.astype(np.int32)]
        while len(open_):
            rank, open_ = _refined(rank, open_, 1 << (len(names) - 1))
            names.append(rank.astype(np.int32))
        self.names, self.n = np.stack(names), len(symbols)
        self.rank = names[-1]
        self.suffixes = np.empty(self.n, np.int64)
        self.suffixes[self.rank] = np.arange(self.n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on (i and j differ)."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += step
            j += step
            found += step
        return found

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and j."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (np.minimum(a, b) >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            step = same.astype(np.int64) << k
            i -= step
            j -= step
            found += step
        return found

    def parts(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two overlapping named stretches that make the stretch of ``size`` words from i on."""
        k = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, len(self.names) - 1)
        return self.names[k, i], self.names[k, np.minimum(i + size - (1 << k), self.n - 1)]

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.parts(i, size), self.parts(j, size)
        return (a == c) & (b == d)

    def occurrences(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in ``suffixes`` of those that begin with the stretch of ``size`` words from i on."""
        bounds = []
        for direction in (-1, 1):
            near = self.rank[i].astype(np.int64)
            far = np.full(len(i), -1 if direction < 0 else self.n)
            while len(wide := np.flatnonzero(np.abs(far - near) > 1)):
                middle = (near[wide] + far[wide]) // 2
                same = self.equal(self.suffixes[middle], i[wide], size[wide])
                near[wide] = np.where(same, middle, near[wide])
                far[wide] = np.where(same, far[wide], middle)
            bounds.append(near)
        return bounds[0], bounds[1]

    def branch(self, i: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A position where the ``size`` words from i on stand, followed by the word at ``word``; -1 where there is none."""
        low, high = self.occurrences(i, size)
        last = high.copy()
        wanted = self.names[0][word]
        while len(wide := np.flatnonzero(low < high)):
            middle = (low[wide] + high[wide]) // 2
            less = self.names[0][self.suffixes[middle] + size[wide]] < wanted[wide]
            low[wide] = np.where(less, middle + 1, low[wide])
            high[wide] = np.where(less, high[wide], middle)
        at = self.suffixes[np.minimum(low, last)]
        return np.where(self.names[0][at + size] == wanted, at, -1)


def previous_factors(f: Factors) -> list[int]:
    """For each position, the length of the longest stretch that also begins earlier (it may overlap)."""
    common = np.zeros(f.n + 1, np.int64)
    common[1 : f.n] = f.ahead(f.suffixes[:-1], f.suffixes[1:])
    common = common.tolist()
    rank, out = f.rank.tolist(), [0] * f.n
    before, after = list(range(-1, f.n)), list(range(1, f.n + 2))
    # the last positions leave first, so that what is left in sorted order begins earlier
    for i in range(f.n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        x, y = common[r], common[q]
        out[i] = x if x > y else y
        common[q] = x if x < y else y
        if p >= 0:
            after[p] = q
        before[q] = p
    return out


def blocks(previous: list[int], starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and the next block's end of the Lempel-Ziv blocks of all texts."""
    begin, after = [], []
    for i, end in zip(starts, ends):
        first = len(begin)
        while i < end:
            begin.append(i)
            i += previous[i] or 1
        after += [*begin[first + 1 :], end] if len(begin) > first else []
    begin, after = np.array(begin, np.int64), np.array(after, np.int64)
    # the last block of a text has no next one: there the end mark stands after its end
    more = np.append(begin[1:] == after[:-1], False)
    return begin, after, np.where(more, np.append(after[1:], 0), after)


def _each(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index i repeated number[i] times, and 0 to number[i] - 1 beside it."""
    of = np.repeat(np.arange(len(number)), number)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)


def covering_squares(f: Factors, begin: np.ndarray, after: np.ndarray, beyond: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, period, number of starts in a row) of squares that cover the vocabulary.

    ``most``: the largest period sought in each block.
    """
    # at a block's end, for periods up to its size
    of, k = _each(np.minimum(after - begin, most))
    at, k1 = after[of], k + 1
    left = at - k1
    # at its beginning, for periods up to its size and the next one's
    of, k = _each(np.minimum(beyond - begin, most))
    inside = begin[of] + k + 1 < beyond[of]
    of, k = of[inside], k[inside]
    left, right = np.append(left, begin[of]), np.append(at, begin[of] + k + 1)
    fits = f.names[0][left] == f.names[0][right]
    left, right = left[fits], right[fits]
    period = right - left
    back, on = f.behind(left, right), f.ahead(left, right)
    fits = back + on >= period
    start, period, number = (left - back)[fits], period[fits], (back + on - period + 1)[fits]
    start, period, number = np.unique(np.stack([start, period, number]), axis=1)
    whole = _primitive(f, start, period)
    return start[whole], period[whole], number[whole]


def _primitive(f: Factors, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which squares have no smaller period that divides theirs."""
    ok, rest, prime = np.ones(len(start), bool), period.copy(), 2
    while len(left := np.flatnonzero(rest > 1)):
        if prime * prime > rest[left].max():  # each rest is a prime
            smaller = period[left] // rest[left]
            ok[left] &= ~f.equal(start[left], start[left] + smaller, 2 * period[left] - smaller)
            break
        if len(has := left[rest[left] % prime == 0]):
            smaller = period[has] // prime
            ok[has] &= ~f.equal(start[has], start[has] + smaller, 2 * period[has] - smaller)
            while len(has):
                rest[has] //= prime
                has = has[rest[has] % prime == 0]
        # a prime rest is tested as soon as no smaller factor can be left
        done = left[(rest[left] > 1) & (rest[left] < (prime + 1) ** 2)]
        if len(done):
            smaller = period[done] // rest[done]
            ok[done] &= ~f.equal(start[done], start[done] + smaller, 2 * period[done] - smaller)
            rest[done] = 1
        prime += 1
    return ok


def vocabulary(f: Factors, start: np.ndarray, period: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a start, period) of every square that is a rotation of the given ones and stands in its text."""
    known = np.zeros((3, 0), np.int64)  # period and the two names of the square
    held = np.zeros((2, 0), np.int64)
    while len(start):
        of, turn = _each(np.minimum(number, period))
        at, k, last = start[of] + turn, period[of], turn + 1 == number[of]
        key = np.stack([k, *f.parts(at, 2 * k)]).astype(np.int64)
        every = np.concatenate([known, key], axis=1)
        order = np.lexsort(every[::-1])
        same = (every[:, order[1:]] == every[:, order[:-1]]).all(axis=0)
        first = np.sort(order[np.append(True, ~same)])
        # lexsort is stable: known squares come first among equals
        new = first[first >= known.shape[1]] - known.shape[1]
        known, held = every[:, first], np.concatenate([held, np.stack([at[new], k[new]])], axis=1)
        # where a text does not go on with the next rotation, a branch may
        ends = new[last[new] & (turn[new] + 1 < k[new])]
        begin, size = at[ends] + 1, 2 * k[ends] - 1
        found = f.branch(begin, size, begin - 1)
        there = found >= 0
        start, period = found[there], k[ends][there]
        number = f.ahead(start, start + period) - period + 1
    return held[0], held[1]


def located_runs(f: Factors, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that the occurrences of the vocabulary make."""
    low, high = f.occurrences(at, 2 * period)
    of, place = _each(high - low + 1)
    start, period = f.suffixes[low[of] + place], period[of]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(period) != 0))) if len(start) else order
    size = np.diff(np.append(new, len(start)))
    return start[new], size - 1 + 2 * period[new], period[new]


def _laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Dense symbols of texts in a row, each with an end mark, and where the texts begin."""
    parts, begin, at, used = [], [], 0, 0
    for words in texts:
        known = dict(zip(dict.fromkeys(words), count(used)))
        begin.append(at)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        used += len(known)
        parts.append(np.array([used], np.int64))
        used += 1
        at += len(words) + 1
    return np.concatenate(parts), np.array(begin, np.int64)


def find_runs(texts: list[list[bytes]], words: int = WORDS, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start and period.

    Runs of at least ``words`` words and ``exponent`` periods (2 at least).
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number = np.arange(len(texts))
    symbols, begin = _laid_out(texts)
    # a run's second period on is a previous factor of so many words at least
    factor = min(max(words - q, (exponent - 1) * q) for q in range(1, words + 1))
    rank, open_ = _named(symbols)
    step = 1
    while 2 * step <= min(factor, 4):
        rank, open_ = _refined(rank, open_, step) if len(open_) else (rank, open_)
        step *= 2
    number = np.unique(np.searchsorted(begin, open_, "right") - 1)
    if not len(number):
        return out
    symbols, begin = _laid_out([texts[i] for i in number])
    size = np.diff(np.append(begin, len(symbols))) - 1
    f = Factors(symbols)
    lz = blocks(previous_factors(f), begin.tolist(), (begin + size).tolist())
    most = (size // exponent)[np.searchsorted(begin, lz[0], "right") - 1]
    start, length, period = located_runs(f, *vocabulary(f, *covering_squares(f, *lz, most)))
    long = length >= np.maximum(words, exponent * period)
    start, length, period = start[long], length[long], period[long]
    of = np.searchsorted(begin, start, "right") - 1
    for i, s, n, q in zip(number[of].tolist(), (start - begin[of]).tolist(), length.tolist(), period.tolist()):
        out[i].append((s, n, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([w for w, n in zip(words, np.cumsum(change).tolist()) if not n])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ADDED = [("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())]


def _strongest(runs: list[tuple[int, int, int]]) -> dict | None:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return best and dict(zip(("start", "length", "period"), best))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, exponent: int = EXPONENT, edit: Edit | None = None) -> DataFrame:
    """key with n_words, ``runs`` (start, length, period; by start, then period), the ``strongest`` and ``collapsed``.

    The strongest has the most periods (length / period, exact; ties: smallest start, then
    period). ``collapsed``: the words that no run holds after its first period, joined by one
    space. ``edit`` (key, words) may give other words for a row before runs are sought.
    """

    def group(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(texts, words, exponent)
        named = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        cols = [[len(t) for t in texts], named, [_strongest(r) for r in found], [collapsed(t, r).decode() for t, r in zip(texts, found)]]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, t) for c, (_, t) in zip(cols, _ADDED)]], names=["key", *[n for n, _ in _ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            for k, raw in zip(batch.column("key"), batch.column("raw")):
                k, split = k.as_py(), (raw.as_py() or b"").split()
                keys.append(k)
                texts.append(edit(k, split) if edit else split)
                size += len(texts[-1]) + 1
                if size >= GROUP:
                    yield group(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield group(keys, texts)

    # the key's Arrow type, for the tasks
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[key].dataType)
    pairs = docs.select(F.col(f"`{key}`").alias("key"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("raw"))
    spans = "struct<start:long,length:long,period:long>"
    out = pairs.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_words long, runs array<{spans}>, strongest {spans}, collapsed string")
    return out.withColumnRenamed("key", key)
