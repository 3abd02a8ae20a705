"""Words compared by their bytes: hashes only sort, equality is checked."""

from __future__ import annotations

import numpy as np

from . import words as W


def differ(ws: W.Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[k] and b[k] are spelled differently, eight bytes at a time."""
    size = ws.end[a] - ws.start[a]
    bad = size != ws.end[b] - ws.start[b]
    eights, x, y = W.eights(ws.data), ws.start[a], ws.start[b]
    live, at = np.flatnonzero(~bad & (a != b)), 0
    while len(live):
        left = W.MASKS[np.minimum(size[live] - at, 8)]
        unlike = (eights[x[live] + at] & left) != (eights[y[live] + at] & left)
        bad[live[unlike]] = True
        at += 8
        live = live[~unlike & (size[live] > at)]
    return bad


def numbered(ws: W.Words, hashes: np.ndarray) -> np.ndarray:
    """One number for each distinct spelling; words of one hash are compared with the first of it."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    bad = differ(ws, np.arange(len(hashes)), first[of])
    if bad.any():  # a collision: those words get numbers by their bytes
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(bad).tolist():
            of[i] = len(first) + more.setdefault(ws.word(i), len(more))
    return of


def joined(ws: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by document) of the kept words, joined by one space within a document."""
    pick = np.flatnonzero(keep)
    upto = np.searchsorted(pick, ws.first)
    start, size = ws.start[pick], ws.end[pick] - ws.start[pick] + 1
    size[upto[1:][upto[1:] > upto[:-1]] - 1] -= 1  # no space behind a document's last word
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    out = np.append(ws.data, np.uint8(32))[at]
    gap = ends[1:] - 1
    last = np.zeros(len(pick), np.bool_)
    last[upto[1:][upto[1:] > upto[:-1]] - 1] = True
    out[gap[~last]] = 32
    return out, ends[upto]
