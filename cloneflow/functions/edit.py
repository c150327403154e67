"""Edit distance of whole strings; longest common block of whole token lists.

Spark's built-in `levenshtein` fills the full table cell by cell; on texts of many thousand characters that is
the whole cost of a job. The bit-parallel form (Myers 1999, in the variant of Hyyrö 2003 for two whole strings)
handles a full column of the table in a few integer operations and gives the same number. Where one text meets many, as an
original its suspects, all of them go through its bits side by side.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The function travels inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of 64 rows that are worked on at once, symbols held for that, and columns between two reads of the last row.
AT_ONCE, MAX_SYMBOLS, READ = 1 << 15, 1 << 23, 512
# Nanoseconds, measured: a step side by side and each word in it; a column of one text alone and each row in it.
STEP, WORD, COLUMN, ROW = 70_000, 16.0, 1_200, 1.5


def distance(a: str, b: str) -> int:
    """Levenshtein distance in characters."""
    if a == b:
        return 0
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for ch in b:
        match = positions.get(ch, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        grow = down | (full & ~(diagonal | up))
        shrink = up & diagonal
        if grow & last:
            score += 1
        elif shrink & last:
            score -= 1
        grow = (grow << 1 | 1) & full
        shrink = shrink << 1 & full
        up = shrink | (full & ~(diagonal | grow))
        down = grow & diagonal
    return score


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _side_by_side(a: str, texts: list[str]) -> np.ndarray:
    """The distances of `a` to texts that are sorted by length, longest first; none is empty.

    The rows of the table are cut into words of 64. A word is one column behind the word above it, whose carry it takes, so that in each
    step all words of all texts are independent of each other.
    """
    known = np.unique(_codes(a))
    words, bit, width = -(-len(a) // 64), np.uint64((len(a) - 1) % 64), len(known) + 1
    match = np.zeros((words, width), np.uint64)
    rows = np.arange(len(a))
    np.bitwise_or.at(match, (rows // 64, np.searchsorted(known, _codes(a)) + 1), np.uint64(1) << (rows % 64).astype(np.uint64))
    match, shift = match.ravel(), np.arange(words)[:, None] * width
    lengths = np.array([len(t) for t in texts])
    steps = int(lengths[0]) + words - 1
    # Symbols by column from the last to the first, blanks (no match) around them: what a step needs is one run of rows.
    symbols = np.zeros((steps + words - 1, len(texts)), np.int32)
    for k, text in enumerate(texts):
        codes = _codes(text)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        symbols[steps - len(codes) : steps, k] = np.where(known[at] == codes, at + 1, 0)[::-1]
    up, down = np.full((words, len(texts)), ~np.uint64(0)), np.zeros((words, len(texts)), np.uint64)
    # What enters a word from above: in the first row of the table the distance grows by one a column.
    plus, minus = np.zeros((words + 1, len(texts)), np.uint64), np.zeros((words + 1, len(texts)), np.uint64)
    plus[0] = 1
    one, top, score, t = np.uint64(1), np.uint64(63), np.full(len(texts), len(a)), 0
    while t < steps:
        # Texts that are not through yet come first.
        n = int(np.searchsorted(-lengths, words - 1 - t, "left"))
        stop = min(t + READ, int(lengths[n - 1]) + words - 1)
        v, d = up[:, :n].copy(), down[:, :n].copy()
        index, eq, x, grow, shrink = np.empty((words, n), np.int64), *(np.empty((words, n), np.uint64) for _ in range(4))
        # What came from above, and what goes to the next column's step.
        (p_now, p_next), (m_now, m_next) = (((c, c[:-1], c[1:]) for c in (whole[:, :n].copy(), whole[:, :n].copy())) for whole in (plus, minus))
        grown, shrunk = np.zeros((stop - t, n), np.uint64), np.zeros((stop - t, n), np.uint64)
        for k in range(stop - t):
            begin = steps - 1 - t - k
            np.add(symbols[begin : begin + words, :n], shift, out=index)
            np.take(match, index, out=eq, mode="clip")
            np.bitwise_or(eq, d, out=x)
            np.bitwise_or(eq, m_now[1], out=eq)
            np.bitwise_and(eq, v, out=shrink)
            np.add(shrink, v, out=shrink)
            np.bitwise_xor(shrink, v, out=shrink)
            np.bitwise_or(shrink, eq, out=shrink)
            np.bitwise_or(shrink, v, out=grow)
            np.invert(grow, out=grow)
            np.bitwise_or(grow, d, out=grow)
            np.bitwise_and(shrink, v, out=shrink)
            grown[k], shrunk[k] = grow[-1], shrink[-1]
            np.right_shift(grow, top, out=p_next[2])
            np.left_shift(grow, one, out=grow)
            np.bitwise_or(grow, p_now[1], out=grow)
            np.right_shift(shrink, top, out=m_next[2])
            np.left_shift(shrink, one, out=shrink)
            np.bitwise_or(shrink, m_now[1], out=shrink)
            np.bitwise_or(x, grow, out=v)
            np.invert(v, out=v)
            np.bitwise_or(v, shrink, out=v)
            np.bitwise_and(grow, x, out=d)
            p_now, p_next, m_now, m_next = p_next, p_now, m_next, m_now
        # The last word has not begun before step words - 1.
        late = max(words - 1 - t, 0)
        score[:n] += ((grown[late:] >> bit & one).sum(axis=0).astype(np.int64) - (shrunk[late:] >> bit & one).sum(axis=0).astype(np.int64))
        up[:, :n], down[:, :n], plus[:, :n], minus[:, :n] = v, d, p_now[0], m_now[0]
        t = stop
    return score


def distances(a: str, texts: list[str]) -> list[int]:
    """The Levenshtein distance of `a` to each text. Equal texts are one; those few that are much longer than the others go alone."""
    found = {t: len(a) + len(t) for t in texts if not a or not t} | {t: 0 for t in texts if t == a}
    left = sorted(set(texts).difference(found), key=len, reverse=True)
    words = -(-len(a) // 64)
    while left:
        some = left[: max(1, min(AT_ONCE // words, MAX_SYMBOLS // (len(left[0]) + words)))]
        lengths = np.array([len(t) for t in some])
        before = np.concatenate([[0], np.cumsum(lengths)])
        together = np.append(STEP * (lengths + words) + WORD * words * (before[-1] - before[:-1]), 0)
        alone = int(np.argmin((COLUMN + ROW * len(a)) * before + together))
        found |= {t: distance(a, t) for t in some[:alone]}
        if some[alone:]:
            found |= zip(some[alone:], _side_by_side(a, some[alone:]).tolist(), strict=True)
        left = left[len(some) :]
    return [found[t] for t in texts]


def longest_block(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of tokens in both, by naming all windows of doubling length (Karp, Miller and
    Rosenberg 1972). The cost does not depend on how often a token repeats."""

    def name(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = np.unique(np.concatenate((x, y)), return_inverse=True)[1]
        return names[: len(x)], names[len(x) :]

    def extend(long: tuple, length: int, short: tuple) -> tuple | None:
        """Names of the windows made of a long window and the short one behind it; None if none is shared."""
        base = len(a) + len(b)
        joined = [
            x[: max(len(y) - length, 0)] * base + y[length:] if len(y) > length else y[:0] for x, y in zip(long, short)
        ]
        pair = name(*joined)
        return pair if np.isin(*pair).any() else None

    levels = [name(a, b)]
    if not np.isin(*levels[0]).any():
        return 0
    while (doubled := extend(levels[-1], 1 << len(levels) - 1, levels[-1])) is not None:
        levels.append(doubled)
    best, length = levels[-1], 1 << len(levels) - 1
    for power in range(len(levels) - 2, -1, -1):
        longer = extend(best, length, levels[power])
        if longer is not None:
            best, length = longer, length + (1 << power)
    return length


def _each(measure: Callable, a: pd.Series, b: pd.Series) -> pd.Series:
    """The measure per row; null where a side is missing."""
    return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    by_text: dict[str, list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None:
            by_text.setdefault(x, []).append(k)
    made: list[int | None] = [None] * len(a)
    for x, places in by_text.items():
        for k, n in zip(places, distances(x, [b.iat[k] for k in places]), strict=True):
            made[k] = n
    return pd.Series(made, dtype="Int32")


@F.pandas_udf(T.IntegerType())
def block_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(longest_block, a, b)
