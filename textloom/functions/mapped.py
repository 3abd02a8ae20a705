"""Normal forms that know where each of their characters comes from.

A form is built for a whole batch of texts at once: every code point has a fixed spelling (compatibility
composition, folded letters and digits, case folded, marks and joiners dropped, white space as one space),
so the batch's distinct code points are spelled once and numpy repeats, joins and thins them. Offsets travel along.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .text import DIGITS_FROM, DIGITS_TO

# Fixed values of this form: letters written alike, and what is dropped (joiners, marks, the lengthening stroke).
LIKE_FROM, LIKE_TO = "كيىېة", "کیییه"
DROPPED = frozenset("‌‍‎‏ـٰ" + "".join(map(chr, [*range(0x064B, 0x0660), *range(0x06D6, 0x06EE)])))
_ALIKE = str.maketrans(LIKE_FROM + DIGITS_FROM, LIKE_TO + DIGITS_TO)


@functools.cache
def spelling(point: int) -> str:
    """What one code point becomes; white space is a space, dropped ones nothing."""
    if 0xD800 <= point < 0xE000:
        return "�"
    kept = (x for x in unicodedata.normalize("NFKC", chr(point)) if x not in DROPPED)
    return "".join(" " if x.isspace() else x.translate(_ALIKE).casefold() for x in kept)


@dataclass
class Forms:
    """Forms of consecutive texts: text d has characters first[d]:first[d + 1], taken from its places ``at``."""

    points: np.ndarray
    at: np.ndarray
    first: np.ndarray

    def text(self, d: int) -> str:
        return self.points[self.first[d] : self.first[d + 1]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of each)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.concatenate([[0], np.cumsum(sizes)])


def forms(texts: list[str], fold: bool = True) -> Forms:
    """The forms of texts; without ``fold`` the texts as they are."""
    points, off = points_of(texts)
    place = np.arange(len(points)) - np.repeat(off[:-1], np.diff(off))
    if not fold:
        return Forms(points, place, off)
    distinct, of = np.unique(points, return_inverse=True)
    spelt = [spelling(p) for p in distinct.tolist()]
    flat, ends = points_of(spelt)
    size = np.diff(ends)[of]
    upto = np.concatenate([[0], np.cumsum(size)])
    out = flat[np.repeat(ends[:-1][of] - upto[:-1], size) + np.arange(upto[-1])]
    at, first = np.repeat(place, size), upto[off]
    blank = out == 32
    before = np.concatenate([[True], blank[:-1]])  # white space first in a text, or behind other white space, goes
    before[first[:-1][first[:-1] < len(out)]] = True
    keep = ~(blank & before)
    left = np.concatenate([[0], np.cumsum(keep)])
    return Forms(out[keep], at[keep], left[first])


def occurrences(form: str, needle: str) -> Iterator[int]:
    """Starts of occurrences that do not overlap."""
    at = form.find(needle)
    while at >= 0:
        yield at
        at = form.find(needle, at + len(needle))
