"""Differences of texts by lines, exactly and in linear space."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


STEPS = 8


def common_lines(a: list, b: list) -> int:
    """Length of the longest common subsequence.

    Common ends are taken off and lines that only one side holds left out. The rest goes along the diagonals of few edits first (greedy, time
    lines + edits squared as a rule); where that costs over ``STEPS`` times the lines, by bit vectors: one number of a bit a line of b holds a whole
    column of the usual table, and each line of a is three operations on it (time n * m / 64 in words, space m bits). Both are exact."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return start + end
    edits = _few_edits(a, b)
    if edits is not None:
        return start + end + (len(a) + len(b) - edits) // 2
    places: dict = {}
    for i, x in enumerate(b):
        places.setdefault(x, []).append(i)
    bulk = {x: _mask(at) for x, at in places.items() if len(at) > 64}  # few lines can be that frequent
    full = (1 << len(b)) - 1
    column = full
    for x in a:
        own = column & (bulk[x] if x in bulk else _mask(places[x]))
        column = ((column + own) | (column - own)) & full
    return start + end + len(b) - column.bit_count()


def _few_edits(a: list, b: list) -> int | None:
    """Least number of lines taken out and put in, None if finding it costs too much."""
    n, m, left = len(a), len(b), STEPS * (len(a) + len(b))
    far = {1: 0}
    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            y = begun = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            left -= 1 + y - begun
            far[k] = x
            if x >= n and y >= m:
                return d
        if left < 0:
            return None
    return n + m


def _mask(at: list[int]) -> int:
    if len(at) < 8:
        return sum(1 << i for i in at)
    raw = bytearray(at[-1] // 8 + 1)
    for i in at:
        raw[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(raw, "little")


@F.pandas_udf(LongType())
def changed_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines taken out and put in between two texts, as few as there can be; 0 if either holds a NUL. A null text is empty."""

    def count(a: str | None, b: str | None) -> int:
        a, b = a or "", b or ""
        if a == b or "\0" in a or "\0" in b:
            return 0
        x, y = a.splitlines(), b.splitlines()
        return len(x) + len(y) - 2 * common_lines(x, y)

    return pd.Series([count(a, b) for a, b in zip(old, new)])
