"""Language identification of code-switched text by a linear-chain conditional random field.

Every word of every line gets marginal label probabilities by forward-backward: byte trigrams, word
affixes and a lexicon score each label, learned transitions tie neighbours. The field learns from whole
documents of one language and from lines spliced from documents of two, so that it knows what a switch
looks like. A document's language is the label of the largest mean marginal over its words; the mean is
its score; ``spans`` gives the runs of words of one label. Work is per row: nothing is shuffled.

Training uses up to TRAIN_DOCS documents a label, samples.MAX_LABELS labels, and TRAIN_CHARS characters in
all (documented bounds) on the driver; the model has a fixed size and is broadcast.

Null texts and texts without a letter are ``und`` with score 0 and no spans; without any labelled document
all are. Labels never enter a prediction. A tie goes to the label that sorts first. Repeated rows get equal
rows; extra columns are ignored; an empty table gives an empty result. A line of over crf.LONGEST words is read in windows that overlap; a
very long text stands alone in its piece, and time follows its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import words as W
from .samples import by_label, held_out, within

TRAIN_DOCS = 120
TRAIN_CHARS = 2_000_000
LEXICON = 4000
_BITS = 15
_T = 1 << _BITS
PIECE = 2 << 20
#: Weights of so many bytes and labels are looked up at once.
HELD = 1 << 22


def _cell(a: np.ndarray, b: np.ndarray, c: np.ndarray, kind: int) -> np.ndarray:
    x = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) << np.uint32(8)) | c
    return ((x * np.uint32(2654435761) + np.uint32(kind * 40503)) >> np.uint32(32 - _BITS)).astype(np.int32) + kind * _T


def _bytes_cells(ws: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cell of each byte in a word, and each word's place among them."""
    size = ws.end - ws.start
    at = np.repeat(ws.start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    d = ws.data
    before, after = d[at - 1], d[np.minimum(at + 1, len(d) - 1)]
    heads = np.cumsum(size) - size
    before[heads] = 32
    after[heads + size - 1] = 32
    return _cell(before, d[at], after, 0), heads


def _affix_cells(ws: W.Words) -> np.ndarray:
    """Four cells a word: its first and last two and three bytes."""
    d, s, e = ws.data, ws.start, ws.end
    pick = lambda i: np.where((i >= s) & (i < e), d[np.clip(i, 0, max(len(d) - 1, 0))], 0)
    zero = np.zeros(len(s), np.uint8)
    return np.stack([_cell(pick(s), pick(s + 1), zero, 1), _cell(pick(s), pick(s + 1), pick(s + 2), 2), _cell(zero, pick(e - 2), pick(e - 1), 3), _cell(pick(e - 3), pick(e - 2), pick(e - 1), 4)], axis=1)


class Model:
    def __init__(self, labels: list[str], lexicon: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.lexicon, self.transitions = labels, lexicon, transitions.astype(np.float32)
        self.weights = weights.astype(np.float32)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon cell of each word; the last stands for all others."""
        at = np.minimum(np.searchsorted(self.lexicon, hashes), max(len(self.lexicon) - 1, 0))
        hit = self.lexicon[at] == hashes if len(self.lexicon) else np.zeros(len(hashes), np.bool_)
        return 5 * _T + np.where(hit, at, LEXICON)

    def scores(self, ws: W.Words) -> np.ndarray:
        if not len(ws.start):
            return np.zeros((0, len(self.labels)), np.float32)
        cells, heads = _bytes_cells(ws)
        out, ends = np.empty((len(heads), self.weights.shape[1]), self.weights.dtype), np.append(heads[1:], len(cells))
        at = 0
        while at < len(heads):  # words of a bounded number of weights at a time
            to = max(at + 1, int(np.searchsorted(ends, heads[at] + HELD // self.weights.shape[1], "right")))
            out[at:to] = np.add.reduceat(self.weights[cells[heads[at] : ends[to - 1]]], heads[at:to] - heads[at], axis=0)
            at = to
        affix = _affix_cells(ws)
        for k in range(affix.shape[1]):
            out += self.weights[affix[:, k]]
        return out + self.weights[self.known(ws.hashes())]


def line_lengths(ws: W.Words) -> np.ndarray:
    """Words of each line that has one, lines never crossing documents."""
    n = len(ws.start)
    if not n:
        return np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(ws.data == 10)])
    new = np.ones(n, np.bool_)
    new[1:] = breaks[ws.start[1:]] > breaks[ws.start[:-1]]
    heads = ws.first[:-1][ws.counts > 0]
    new[heads] = True
    return np.diff(np.append(np.flatnonzero(new), n))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spliced(samples: list[tuple], seed: int = 21) -> list[tuple[str, list]]:
    """Lines that switch between two documents of different labels, two to four times, with each word's label."""
    random, out = np.random.RandomState(seed), []
    worded = [(y, w) for _, y, t in samples if (w := _WORD.findall(t))]
    for y, w in worded:
        z, v = worded[random.randint(len(worded))]
        if y == z:
            continue
        line, gold = [], []
        for k in range(random.randint(2, 5)):
            label, words = ((y, w), (z, v))[k % 2]
            at, size = random.randint(len(words)), random.randint(3, 13)
            line += words[at : at + size]
            gold += [label] * len(words[at : at + size])
        out.append((" ".join(line), gold))
    return out


def train(samples: list[tuple], steps: int = 40) -> Model | None:
    """A model from (id, label, text) rows; None without any."""
    samples = within(samples, TRAIN_CHARS)
    labels = sorted({s[1] for s in samples})
    if not labels:
        return None
    lines = spliced(samples)
    ws = W.tokenize(pa.array([s[2] for s in samples] + [t for t, _ in lines], pa.string()), W.SPACED, lower=True)
    if not len(ws.start):
        return None
    hashes = ws.hashes()
    most = [h for h, c in sorted(Counter(hashes.tolist()).items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c > 2]
    model = Model(labels, np.array(sorted(most), np.uint64), np.zeros((5 * _T + LEXICON + 1, len(labels))), np.zeros((len(labels),) * 2))
    cells, heads = _bytes_cells(ws)
    n = len(ws.start)
    size = ws.end - ws.start
    affix = _affix_cells(ws)
    rows = np.concatenate([cells, affix.ravel(), model.known(hashes)])
    owner = np.concatenate([np.repeat(np.arange(n), size), np.repeat(np.arange(n), affix.shape[1]), np.arange(n)])
    number = {y: k for k, y in enumerate(labels)}
    gold = np.repeat(np.array([number[s[1]] for s in samples]), ws.counts[: len(samples)])
    gold = np.concatenate([gold, np.array([number[y] for _, ys in lines for y in ys], gold.dtype)])
    w, t = crf.fit(line_lengths(ws), rows, owner, len(model.weights), gold, len(labels), steps)
    return Model(labels, model.lexicon, w, t)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def word_marginals(model: Model, texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    ws = W.tokenize(texts, W.SPACED, lower=True)
    if not len(ws.start):
        return ws, np.zeros((0, len(model.labels)))
    return ws, crf.marginals(line_lengths(ws), model.scores(ws), model.transitions)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixed: the share of words whose own label is another than the document's."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = sent.value
        ascii_letter = np.zeros(256, np.bool_)
        ascii_letter[97:123] = True
        for batch in batches:
            for piece in W.pieces(batch, "_text", PIECE):
                n = piece.num_rows
                pred, score, mixed = ["und"] * n, np.zeros(n), np.zeros(n)
                if m is not None:
                    ws, g = word_marginals(m, piece.column("_text"))
                    full = np.flatnonzero(ws.counts > 0)
                    if len(full):
                        heads = ws.first[:-1][full]
                        mean = np.add.reduceat(g.astype(np.float64), heads, axis=0) / ws.counts[full][:, None]
                        best = mean.argmax(axis=1)
                        other = (g.argmax(axis=1) != np.repeat(best, ws.counts[full])).astype(np.int64)
                        others = np.add.reduceat(other, heads) / ws.counts[full]
                        letters = np.concatenate([[0], np.cumsum(ascii_letter[ws.data])])
                        some = letters[ws.end[ws.first[1:][full] - 1]] > letters[ws.start[heads]]
                        for k, d in enumerate(full.tolist()):
                            if some[k] or _has_letter(piece.column("_text")[d].as_py()):
                                pred[d], score[d], mixed[d] = m.labels[best[k]], min(1.0, float(mean[k, best[k]])), others[k]
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(mixed)], names=["id", "lang_pred", "score", "mixed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, mixed double").withColumnRenamed("id", id_col)


def spans(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: (lang, start, end) of each run of words of one label, in code points, ends exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = sent.value
        for batch in batches:
            for piece in W.pieces(batch, "_text", PIECE):
                out: list[list] = [[] for _ in range(piece.num_rows)]
                if m is not None:
                    ws, g = word_marginals(m, piece.column("_text"))
                    points = np.concatenate([[0], np.cumsum((ws.data & 0xC0) != 0x80)])
                    base = points[np.concatenate([[0], np.cumsum([x or 0 for x in pa.compute.binary_length(piece.column("_text")).to_pylist()])])]
                    label = g.argmax(axis=1)
                    owner = np.repeat(np.arange(piece.num_rows), ws.counts)
                    new = np.ones(len(label), np.bool_)
                    new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                    heads = np.flatnonzero(new)
                    for i, j in zip(heads.tolist(), np.append(heads[1:], len(label)).tolist()):
                        d = owner[i]
                        out[d].append({"lang": m.labels[label[i]], "start": int(points[ws.start[i]] - base[d]), "end": int(points[ws.end[j - 1]] - base[d])})
                    for d, text in enumerate(piece.column("_text").to_pylist()):
                        if out[d] and not _has_letter(text):
                            out[d] = []
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(out, kind)], names=["id", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {id_kind}, spans array<struct<lang:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixed; learns from rows of which crc32(id) mod 4 is not 2."""
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).alias("_lang")).where(~held_out("_id", 4, 2))
    model = train(by_label(kept, "_id", "_text", F.col("_lang"), train_docs))
    done = predict(docs, model, id_col, text_col)
    return done.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "lang_pred", "score", "mixed")
