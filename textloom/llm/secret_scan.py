"""Secret spans: three fixed patterns, and a linear-chain conditional random field that adds to them.

Words of each line are tagged secret begin, inside or outside by Viterbi over shape features, the shape
and keyword class of both neighbours, and features of the whole document. The field learns from the
fixed patterns' matches, and from copies of their lines in which the value has another alphabet, length or
prefix and the keyword is another or none, so that it can't lean on what the patterns already see;
look-alikes that are no secrets (addresses, times, versions, paths, plain numbers) stand against them.
Training uses up to TRAIN_DOCS documents that look keyed and as many others, TRAIN_CHARS characters in all
(documented bounds); nothing is shuffled. A tagged word's core becomes a span of kind ``crf`` when it
overlaps no fixed match, has 12 bytes or more, and holds letters and digits; lines without such a word need
no tags.

Null texts are empty. Offsets are code points, ends exclusive. Work is linear in a text's length, whatever
its number of spans; a line of over crf.LONGEST words is read in windows that overlap. Repeated rows get equal rows; extra columns are ignored; an empty table gives an empty
result, and without any match to learn from the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import words as W
from .language_id import line_lengths
from .samples import by_label, within

# The patterns, and the least length of what counts.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"key", b"bearer", b"credential", b"auth")

TRAIN_DOCS = 400
TRAIN_CHARS = 4_000_000
PIECE = 2 << 20
_LONG_HEX = re.compile(rb"[0-9a-f]{16,}")
_KEYED = re.compile(rb"password|passwd|secret|token|api_?key")
_NAMES = re.compile(b"|".join(KEYWORDS))


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes; matches are found leftmost and apart, then short ones dropped."""
    out = []
    if _KEYED.search(raw.lower()):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    # hex runs are maximal, so asking for the length at once finds the same ones
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _table(*ranges: range) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for r in ranges:
        t[list(r)] = 1
    return t


_DIGIT, _UPPER, _LOWER, _HIGH = _table(range(48, 58)), _table(range(65, 91)), _table(range(97, 123)), _table(range(128, 256))
_MARK = _table(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
#: Own shape by parts: length, digits, upper, lower, marks, changes at digits, two pairs of them, changes of any class, and which of / . @ it has.
_PARTS = (6, 4, 3, 3, 3, 4, 6 * 4, 4 * 4, 4, 8)
SHAPES = sum(_PARTS)
#: Then previous and next word (length x digits, or none), keywords before, in and after, and the document.
_COARSE = 6 * 4
_SIZE = SHAPES + 2 * (_COARSE + 1) + 8 + 6 * 3
_KEY_AT = SHAPES + 2 * (_COARSE + 1)
LEAST_CORE = 12


@dataclass
class Page:
    """Words of some texts with what the features need of all of them: lines, digits, keywords, and a class of each text."""

    ws: W.Words
    line: np.ndarray
    lines: int
    digits: np.ndarray
    keyed: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, ws: W.Words) -> Page:
        n, docs = len(ws.start), len(ws.first) - 1
        lengths = line_lengths(ws)
        digits = _per(ws, _DIGIT)
        raw, keyed = ws.data.tobytes().lower(), np.zeros(n, np.bool_)
        for m in _NAMES.finditer(raw):
            i = int(np.searchsorted(ws.start, m.start(), "right")) - 1
            if i >= 0:
                keyed[i] = True
        # of the document: the share of words with digits, and whether it names a keyword
        owner = np.repeat(np.arange(docs), ws.counts)
        share = np.bincount(owner, digits > 0, docs) / np.maximum(ws.counts, 1)
        named = np.bincount(owner, keyed, docs) > 0
        doc = np.digitize(share, (0.001, 0.01, 0.05, 0.2, 0.5)) * 3 + named
        return cls(ws, np.repeat(np.arange(len(lengths)), lengths), len(lengths), digits, keyed, doc[owner])

    def lines_with(self, words: np.ndarray) -> np.ndarray:
        """Words of all lines that hold one of ``words`` (a mask), in order."""
        return np.flatnonzero((np.bincount(self.line, words, self.lines) > 0)[self.line]) if len(self.line) else np.zeros(0, np.int64)


def _per(ws: W.Words, table: np.ndarray) -> np.ndarray:
    """Bytes of a class in each word."""
    c = np.concatenate([[0], np.cumsum(table[ws.data], dtype=np.int32)])
    return c[ws.end] - c[ws.start]


def word_features(page: Page, pick: np.ndarray) -> np.ndarray:
    """Feature rows of the picked words, which are whole lines."""
    ws, d = page.ws, page.ws.data
    start, end = ws.start[pick], ws.end[pick]
    # bytes of the picked words alone
    size = end - start
    upto = np.concatenate([[0], np.cumsum(size)])
    own = d[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]

    def per(hits: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
        return c[upto[1:]] - c[upto[:-1]]

    kind = (_DIGIT + 2 * _UPPER + 3 * _LOWER + 4 * _MARK + 5 * _HIGH)[own]
    turn = np.zeros(len(own), np.bool_)
    turn[1:] = kind[1:] != kind[:-1]
    turn[upto[:-1][size > 0]] = False
    at_digit = turn.copy()
    at_digit[1:] &= (kind[1:] == 1) | (kind[:-1] == 1)
    digits, upper, lower, marks, changes, turns = (per(x) for x in (kind == 1, kind == 2, kind == 3, kind == 4, at_digit, turn))
    length = np.digitize(size, (4, 8, 12, 16, 24))
    some = lambda x: np.digitize(x, (1, 4))
    digit, change = np.digitize(digits, (1, 3, 8)), np.digitize(changes, (1, 3, 6))
    has = sum((per(own == ord(c)) > 0).astype(np.int64) << k for k, c in enumerate("/.@"))
    shape, at = [], 0
    for x, m in zip((length, digit, some(upper), some(lower), np.digitize(marks, (1, 2)), change, length * 4 + change, digit * 4 + change, np.digitize(turns, (2, 5, 9)), has), _PARTS):
        shape.append(at + x)
        at += m
    n, line = len(pick), page.line[pick]
    coarse, keyed = length * 4 + digit, page.keyed[pick]

    def beside(x: np.ndarray, step: int, none) -> np.ndarray:
        """x of the word ``step`` places on in the same line."""
        out = np.full(n, none, x.dtype)
        to = np.arange(max(0, -step), n - max(0, step))
        same = to[line[to] == line[to + step]]
        out[same] = x[same + step]
        return out

    key = keyed * 1 + (beside(keyed, -1, False) | beside(keyed, -2, False)) * 2 + beside(keyed, 1, False) * 4
    return np.stack([*shape, SHAPES + beside(coarse, -1, _COARSE), SHAPES + _COARSE + 1 + beside(coarse, 1, _COARSE), _KEY_AT + key, _KEY_AT + 8 + page.doc[pick]], axis=1)


class Model:
    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights.astype(np.float32), transitions.astype(np.float32)
        self.transitions[0, 2] = -1e4  # inside follows begin or inside only
        self.start = np.array([0, 0, -1e4], np.float32)

    def tag(self, ws: W.Words) -> np.ndarray:
        """Labels of all words; lines without a word that could hold a secret are outside."""
        page, out = Page.of(ws), np.zeros(len(ws.start), np.int8)
        pick = page.lines_with((ws.end - ws.start >= LEAST_CORE) & (page.digits > 0))
        if len(pick):
            rows = word_features(page, pick)
            scores = self.weights[rows[:, 0]]
            for k in range(1, rows.shape[1]):
                scores = scores + self.weights[rows[:, k]]
            out[pick] = crf.labels(_lengths(page.line[pick]), scores, self.transitions, self.start)
        return out


def _lengths(line: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])), len(line)))


_UPPERS, _LOWERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = (_UPPERS + _DIGITS, _UPPERS + _LOWERS + _DIGITS, _UPPERS + _LOWERS + _DIGITS + "+/", "ABCDEF" + _DIGITS, _LOWERS + _DIGITS)
_KEYS = ("password", "secret", "token", "api_key", "apikey", "credential", "auth", "bearer", "key", "value", "code", "login", "access")


def _some(random: np.random.RandomState, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in random.randint(len(letters), size=random.randint(low, high)))


def _made_up(random: np.random.RandomState) -> str:
    """A value of some alphabet and length, with a prefix now and then."""
    value = _some(random, _ALPHABETS[random.randint(len(_ALPHABETS))], 16, 49)
    lead = random.randint(4)
    return (_some(random, _LOWERS, 2, 5) + "_-"[lead] if lead < 2 else "") + value + "=" * (random.randint(6) == 0)


def _alike(random: np.random.RandomState) -> str:
    """Something with digits that is no secret."""
    letters = (_LOWERS, _LOWERS, _LOWERS, _ALPHABETS[1])[random.randint(4)]
    name, n = (lambda: _some(random, letters, 3, 11)), (lambda k: _some(random, _DIGITS, k, k + 1))
    return (
        lambda: f"{name()}.{n(2)}@{name()}{n(1)}.{name()}.com", lambda: f"https://{name()}.{name()}.org/{name()}/{n(4)}.html", lambda: f"20{n(2)}-0{n(1)}-1{n(1)}T0{n(1)}:1{n(1)}:2{n(1)}Z",
        lambda: f"v{n(1)}.{n(2)}.{n(1)}-{name()}{n(1)}", lambda: f"/{name()}/{name()}{n(2)}/{name()}.{name()}", lambda: f"{n(3)}.{n(2)}.{n(1)}.{n(3)}", lambda: n(16), lambda: f"{name()}_{name()}_{name()}{n(1)}",
        lambda: f"{name()}-{name()}-{name()}-{n(4)}", lambda: f"{n(1)},{n(3)},{n(3)}.{n(2)}", lambda: f"+{n(2)}-{n(3)}-{n(7)}", lambda: f"{name()}{name().title()}{name().title()}{n(1)}", lambda: f"{n(4)}x{n(4)}px",
    )[random.randint(13)]()


def lessons(texts: list[str], seed: int = 9) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Texts with the byte ranges of their secrets: the given ones by the fixed patterns (of an assignment, its
    value; no mere numbers), then each line of a match again with other values and keywords, and with look-alikes."""
    random, out, more = np.random.RandomState(seed), [], []
    for text in texts:
        raw = text.encode()
        named = [m for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]] if _KEYED.search(raw.lower()) else []
        taken = [(m.start(1), m.end(1), m.start(2), m.end(2)) for m in named]
        for k, s, e in base_spans(raw):
            if (k == "access" or k == "hex" and not raw[s:e].isdigit()) and not any(a <= s and e <= b for *_, a, b in taken):
                taken.append((s, s, s, e))
        out.append((raw, [(a, b) for *_, a, b in taken]))
        for k0, k1, a, b in taken[:20]:
            lo, hi = raw.rfind(b"\n", 0, k0) + 1, raw.find(b"\n", b)
            head, sign, tail = raw[max(lo, k0 - 400) : k0], raw[k1:a], raw[b : min(hi if hi >= 0 else len(raw), b + 400)]
            for _ in range(3):
                value, key = _made_up(random).encode(), _KEYS[random.randint(len(_KEYS))].encode() if random.randint(3) else b""
                front = head.decode("utf-8", "ignore").encode() + (key + (sign if k1 > k0 and random.randint(2) else (b" ", b": ", b"=", b" is ")[random.randint(4)]) if key else b"")
                more.append((front + value + tail, [(len(front), len(front) + len(value))]))
                key = _KEYS[random.randint(len(_KEYS))].encode() + b" " if random.randint(3) == 0 else b""
                more.append((head.decode("utf-8", "ignore").encode() + key + _alike(random).encode() + tail, []))
    return out + more


def train(texts: list[str], steps: int = 80, seed: int = 9) -> Model | None:
    """Learns from all lines that hold a digit or a keyword, and from one other line in ten."""
    taught = lessons(texts, seed)
    ws = W.tokenize(pa.array([t for t, _ in taught], pa.binary()))
    gold, off = np.zeros(len(ws.start), np.int64), 0
    for raw, secrets in taught:
        for s, e in secrets:
            i, j = np.searchsorted(ws.end, off + s, "right"), np.searchsorted(ws.start, off + e, "left")
            gold[i:j] = 2
            gold[i] = 1
        off += len(raw)
    if not gold.any():
        return None
    page = Page.of(ws)
    told = (page.digits > 0) | page.keyed | (gold > 0)
    use = (np.bincount(page.line, told, page.lines) > 0) | (np.random.RandomState(seed).rand(page.lines) < 0.1)
    pick = np.flatnonzero(use[page.line])
    rows = word_features(page, pick)
    w, t = crf.fit(_lengths(page.line[pick]), rows.ravel(), np.repeat(np.arange(len(rows)), rows.shape[1]), _SIZE, gold[pick], 3, steps)
    return Model(w, t)


_CORE = re.compile(rb"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-]")
_DIGIT_IN, _LETTER_IN = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def added_spans(ws: W.Words, tags: np.ndarray, raw: bytes, base: dict[int, list]) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) in bytes of the runs that the field adds."""
    taken = np.zeros(len(raw) + 1, np.int32)
    for spans in base.values():
        for _, s, e in spans:
            taken[s] += 1
            taken[e] -= 1
    taken = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)])
    begins = np.flatnonzero(tags == 1)
    owner = np.searchsorted(ws.first, begins, "right") - 1
    outside = np.append(np.flatnonzero(tags != 2), len(tags))
    ends = outside[np.searchsorted(outside, begins, "right")]
    for i, j, d in zip(begins.tolist(), np.minimum(ends, ws.first[owner + 1]).tolist(), owner.tolist()):
        for m in _CORE.finditer(raw, int(ws.start[i]), int(ws.end[j - 1])):
            if m.end() - m.start() >= LEAST_CORE and _DIGIT_IN.search(m[0]) and _LETTER_IN.search(m[0]) and taken[m.end()] == taken[m.start()]:
                yield d, m.start(), m.end()


def _scan(sent):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for batch in batches:
            for piece in W.pieces(batch, "_text", PIECE):
                texts = piece.column("_text")
                ws = W.tokenize(texts)
                off = np.zeros(piece.num_rows + 1, np.int64)
                np.cumsum([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], out=off[1:])
                raw = ws.data.tobytes()
                found: dict[int, list] = {}
                for d, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist())):
                    if spans := base_spans(raw[a:b]):
                        found[d] = [(k, s + a, e + a) for k, s, e in spans]
                more: dict[int, list] = {}
                if model is not None and len(ws.start):
                    for d, s, e in added_spans(ws, model.tag(ws), raw, found):
                        more.setdefault(d, []).append(("crf", s, e))
                rows = [nothing] * piece.num_rows
                if found or more:
                    points = np.concatenate([[0], np.cumsum((ws.data & 0xC0) != 0x80)])
                for d in found.keys() | more.keys():
                    own, zero = found.get(d, []), points[off[d]]
                    text = lambda spans, zero=zero: ",".join(f"{k}:{points[s] - zero}:{points[e] - zero}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))
                    kinds = [k for k, _, _ in own]
                    rows[d] = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(text(own).encode()).hexdigest(), text(own + more.get(d, [])))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learns from up to train_docs documents that look keyed or random, and as many others."""
    # linear patterns: no run is tried from each of its characters again
    likely = F.col("_text").rlike("[0-9][0-9A-Za-z]{9}|[Pp]assw|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey|AKIA")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return train([t for _, _, t in within(by_label(rows, "_id", "_text", likely, train_docs), TRAIN_CHARS)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; learns from docs unless a model is given."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col, train_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_scan(sent), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
