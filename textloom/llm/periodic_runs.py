"""Periodic runs of words: Lyndon words under both orders, extended by rolling-hash LCE.

A run is a stretch of consecutive words with smallest period q, at least ``min_words`` and at least 2q words
long, that no neighbouring word extends. By the runs theorem every run holds a Lyndon root: the longest Lyndon word
that starts at some of its words, under the order of the words or its reverse. Both orders are scanned from right to
left with a stack of Lyndon words, kept as a link from each word to where its word ends. Suffixes are compared, and roots
extended to both sides, by the longest common extension (LCE): a few words one by one, then binary search
on prefix hashes. What the hashes call equal is compared word by word before it counts, and remembered by
its offset so that no stretch is compared twice in a scan. Words are numbers given by spelling, not by hash.

Only stretches that can hold a run are scanned: in a run of n words of period q the first n - q words come again q words
later, so every word of it lies in a window of half of ``min_words`` words that the document holds twice.
Windows are found by sorting their hashes; a collision there only costs time.

Documents are never shuffled. A null or empty text has no words and no runs; a null id is an id like others; ties
cannot arise (runs are listed by start, then period); repeated rows give equal rows; an empty table gives an
empty result; extra columns are ignored by ``find`` and kept, whatever their names, by ``collapse``. A very
long text stands alone in its piece and takes time in proportion to its words (times the logarithm in binary search).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exact
from . import words as W
from .store import quoted

MIN_WORDS = 12
#: Words compared one by one before prefix hashes are searched.
FEW = 8
_MOD, _BASE = (1 << 61) - 1, 0x1234567_89ABCDE
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extender:
    """LCE of suffixes and of prefixes of one word sequence."""

    def __init__(self, ids: np.ndarray):
        self.array, self.ids, self.n = ids, ids.tolist(), len(ids)
        self.prefix: list[int] = []
        self.known: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> None:
        h, p, self.prefix, self.power = 0, 1, [0], [1]
        for x in self.ids:
            h = (h * _BASE + x + 1) % _MOD
            p = p * _BASE % _MOD
            self.prefix.append(h)
            self.power.append(p)

    def _search(self, i: int, j: int, low: int, high: int, step: int) -> int:
        """The most words, from low to high, whose hashes agree: after i and j (step 1) or before them (-1)."""
        if not self.prefix:
            self._hashes()
        h, power = self.prefix, self.power
        while low < high:
            k = (low + high + 1) // 2
            a, b = (i, j) if step > 0 else (i - k, j - k)
            if (h[a + k] - h[a] * power[k] - h[b + k] + h[b] * power[k]) % _MOD == 0:
                low = k
            else:
                high = k - 1
        return low

    def _straight(self, i: int, j: int, most: int, step: int) -> int:
        """By words alone."""
        w, k = self.ids, 0
        while k < most and (w[i + k] == w[j + k] if step > 0 else w[i - 1 - k] == w[j - 1 - k]):
            k += 1
        return k

    def agreed(self, i: int, j: int, most: int, step: int = 1) -> int:
        """As far as hashes agree; never less than the truth."""
        k = self._straight(i, j, min(most, FEW), step)
        return k if k < FEW or k == most else self._search(i, j, k, most, step)

    def ahead(self, i: int, j: int) -> int:
        """Words that the suffixes at i < j share, verified; amortised by offset."""
        d = j - i
        at, more = self.known.get(d, (self.n - d, 0))
        if at <= i <= at + more:
            return at + more - i
        most = at - i if at > i else self.n - j
        k = self.agreed(i, j, most)
        if k > FEW and not np.array_equal(self.array[i : i + k], self.array[j : j + k]):
            k = self._straight(i, j, most, 1)
        if at > i and k == most:
            k += more
        self.known[d] = (i, k)
        return k


def lyndon_ends(lce: Extender, reverse: bool = False) -> list[int]:
    """Where the longest Lyndon word from each word on ends: the next smaller suffix, right to left."""
    w, n = ([-x for x in lce.ids] if reverse else lce.ids), lce.n
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        a, j = w[i], i + 1
        while j < n:
            b = w[j]
            if a == b:
                k = lce.ahead(i, j)
                if j + k >= n or w[i + k] > w[j + k]:
                    break
            elif a > b:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one word sequence, by start, then period."""
    lce, found, n = Extender(ids), set(), len(ids)
    for reverse in (False, True):
        ends = np.array(lyndon_ends(lce, reverse), np.int64)
        roots = np.flatnonzero(ends < n)
        roots = roots[ids[roots] == ids[ends[roots]]]  # else the word is in no run of that period from its start on
        done: dict[int, int] = {}
        for i, j in zip(roots.tolist(), ends[roots].tolist()):
            p = j - i
            if i < done.get(p, 0):
                continue
            right, left = lce.agreed(i, j, n - j), lce.agreed(i, j, i, -1)
            start, length = i - left, left + right + p
            done[p] = i + right
            if length < max(min_words, 2 * p) or (start, length, p) in found:
                continue
            if not np.array_equal(ids[start : start + length - p], ids[start + p : start + length]):
                right, left = lce._straight(i, j, n - j, 1), lce._straight(i, j, i, -1)
                start, length = i - left, left + right + p
                done[p] = i + right
                if length < max(min_words, 2 * p):
                    continue
            found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ws: W.Words, hashes: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(document, first word, end) of what can hold runs: words in windows that their document holds twice."""
    width = max(1, (min_words + 1) // 2)
    found, at = ws.windows(hashes, width)
    if not len(at):
        return []
    doc = np.searchsorted(ws.first, at, "right") - 1
    _, of, many = np.unique(W.mix(found ^ W.mix(doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    at = at[many[of] > 1]
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    inside = np.cumsum(step[:-1]) > 0
    edge = np.zeros(len(inside) + 1, np.bool_)
    edge[ws.first] = True
    opens = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    shuts = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    doc = np.searchsorted(ws.first, opens, "right") - 1
    return [(d, a, b) for d, a, b in zip(doc.tolist(), opens.tolist(), shuts.tolist()) if b - a >= min_words]


def runs_in(ws: W.Words, min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, starts counted from its first word."""
    hashes = ws.hashes()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ws.first) - 1)]
    there = stretches(ws, hashes, min_words)
    if there:
        ids = exact.numbered(ws, hashes)
        for d, a, b in there:
            at = a - int(ws.first[d])
            out[d] += [(at + s, n, p) for s, n, p in runs_of(ids[a:b], min_words)]
    return out


def _kept(ws: W.Words, runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Words that no run holds after its first period."""
    step = np.zeros(len(ws.start) + 1, np.int64)
    for first, own in zip(ws.first.tolist(), runs):
        for s, n, p in own:
            step[first + s + p] += 1
            step[first + s + n] -= 1
    return np.cumsum(step[:-1]) == 0


def _scan(min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                ws = W.tokenize(piece.column("_text"))
                runs = runs_in(ws, min_words)
                data, at = exact.joined(ws, _kept(ws, runs))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
                listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], RUNS)
                yield pa.RecordBatch.from_arrays([piece.column("_c"), pa.array(ws.counts, pa.int64()), listed, texts.cast(pa.large_string()).cast(pa.string())], names=["_c", "n_words", "runs", "collapsed"])

    return scan


def _found(docs: DataFrame, carried, text_col: str, min_words: int) -> DataFrame:
    df = docs.select(carried.alias("_c"), docs[quoted(text_col)].alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    out = T.StructType([df.schema["_c"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return df.mapInArrow(W.lean(_scan(min_words)), out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, n_words, runs (start and length in words, period; by start, then period), collapsed (the words that no run
    holds after its first period, joined by one space)."""
    return _found(docs, docs[quoted(id_col)], text_col, min_words).withColumnRenamed("_c", id_col)


def collapse(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the input's columns; texts with runs become their collapsed words, others stay as written."""
    names = docs.columns
    row = F.struct(*[docs[quoted(c)].alias(f"c{k}") for k, c in enumerate(names)])
    done = _found(docs, row, text_col, min_words)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"_c.c{names.index(text_col)}"))
    return done.select(*[(text if c == text_col else F.col(f"_c.c{k}")).alias(c) for k, c in enumerate(names)])
