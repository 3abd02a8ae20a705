"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text; a document of label 1 is preferred to one
of label 0, and the weights minimise the logistic loss on the feature differences of all such pairs of all
labelled training documents: nothing is sampled. The strength at the quantile of label-0 documents among the
training rows becomes the score THRESHOLD, the rest follows a logistic curve.

Features are measured over whole texts in one pass without a shuffle and written, 15 numbers a document. Training
reads the labelled ones again at each step: the loss of a pair depends on two strengths alone, so counts and sums of
features by label and strength, of BINS steps, stand for all pairs (strengths within a step count as their mean). A step
of Newton's method uses the greatest curvature, which is that of pairs of equal strength and needs one pass. Sums are of
whole numbers, so they do not depend on the order of rows, and what tasks send is of fixed size.

Null texts count as empty and get the score of an empty text. Without both labels every score is 0.5. Equal
strengths at the cut share a score and a side of it. A label stated twice counts once, a text of an id once for each of its labels.
An empty table gives an empty result. Repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .samples import held_out
from .store import saved

THRESHOLD = 0.3
#: Newton steps; weight of the squared weights; steps of strengths from -REACH to REACH; most scales from the mean.
STEPS, DECAY, BINS, REACH, FAR = 20, 1e-3, 256, 16.0, 32.0
#: Training values as whole numbers: units of measures, of scaled features in first sums and in second ones.
UNIT, FINE, COARSE = 2.0**20, 2.0**12, 2.0**8
#: Values collected to find one of a given rank.
FEW = 20_000

_CLASSES = {
    "lower": [range(97, 123)], "upper": [range(65, 91)], "digit": [range(48, 58)], "high": [range(128, 256)], "line": [range(10, 11)],
    "bang": [range(33, 34)], "bar": [range(124, 125)], "symbol": [range(35, 39), range(42, 43), range(60, 61), range(62, 63)], "stop": [range(46, 47), range(63, 64)], "comma": [range(44, 45)],
}


def measures(texts: pa.Array) -> np.ndarray:
    """One row a text: shares of byte classes, and how much words, word pairs and lines repeat."""
    ws = W.tokenize(texts)
    n = len(texts)
    off = np.zeros(n + 1, np.int64)
    np.cumsum([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], out=off[1:])
    chars, count = np.maximum(np.diff(off), 1), ws.counts
    some = np.maximum(count, 1)
    columns = []
    per = {}
    for name, ranges in _CLASSES.items():
        table = np.zeros(256, np.bool_)
        for r in ranges:
            table[list(r)] = True
        hits = np.concatenate([[0], np.cumsum(table[ws.data])])
        per[name] = hits[off[1:]] - hits[off[:-1]]
    letters = np.maximum(per["lower"] + per["upper"] + per["high"], 1)
    columns += [per["upper"] / letters, per["digit"] / chars, per["high"] / chars]
    columns += [np.minimum(per[k] / some, 3.0) for k in ("bang", "bar", "symbol", "stop", "comma", "line")]
    h = ws.hashes()
    owner = np.repeat(np.arange(n), count)

    def distinct(hashes: np.ndarray, who: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, who))
        a, b = hashes[order], who[order]
        new = np.ones(len(a), np.bool_)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.bincount(b[new], minlength=n)

    columns.append(np.where(count > 0, distinct(h, owner) / some, 1.0))
    three, at = ws.windows(h, 3)
    m = np.bincount(owner[at], minlength=n)
    columns.append(np.where(m > 0, distinct(three, owner[at]) / np.maximum(m, 1), 1.0))
    columns += [np.log1p(count), np.minimum(chars / some, 40.0) / 10, (count == 0).astype(float)]
    return np.stack(columns, axis=1).astype(np.float64)


def features(x: np.ndarray) -> np.ndarray:
    """Measures, their roots and squares."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


#: Measures of a text.
MEASURES = measures(pa.array([""])).shape[1]


class Model:
    """Strength = weights . (features - mean) / scale, and its curve to 0..1."""

    def __init__(self, mean, scale, weights=None, at=0.0, slope=1.0):
        self.mean, self.scale, self.weights, self.at, self.slope = mean, scale, weights, at, slope

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((features(x) - self.mean) / self.scale, -FAR, FAR)

    def strength(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a matrix product's last bit would depend on a row's place
        return (self.scaled(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.at) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, MEASURES)


def _whole(x: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(x * unit).astype(np.int64)


def _sums(rows: DataFrame, of) -> dict[int, tuple[int, np.ndarray]]:
    """By label: the number of rows, and the sum of ``of(measures)``, whole numbers; one row of fixed size a task and label reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            for label in np.unique(y).tolist():
                n, total = out.get(label, (0, 0))
                out[label] = (n + int((y == label).sum()), total + of(x[y == label]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.list_(pa.int64()))], names=["y", "n", "s"])

    total: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows.mapInArrow(run, "y int, n long, s array<long>").toLocalIterator():
        n, s = total.get(r.y, (0, 0))
        total[r.y] = (n + r.n, s + np.array(r.s, np.int64))
    return total


def _ranked(values: DataFrame, rank: int) -> float:
    """The value of that rank, from 0, in ascending order of column s: counts by ever narrower steps, until few are left."""
    values = values.select("s")
    while True:
        low, high, n = values.agg(F.min("s"), F.max("s"), F.count("*")).first()
        if low == high:
            return low
        if n <= FEW:
            return sorted(r[0] for r in values.collect())[rank]
        step = F.least(F.floor((F.col("s") - low) / (high - low) * 1024), F.lit(1023))
        for k, many in sorted((r[0], r[1]) for r in values.groupBy(step).count().collect()):
            if rank < many:
                values = values.where(step == k)
                break
            rank -= many


def train(rows: DataFrame) -> Model | None:
    """rows: y (0 or 1), x (measures) of all training documents."""
    both = _sums(rows, lambda x: np.concatenate([_whole(features(x), UNIT), _whole(features(x) ** 2, UNIT)], axis=1).sum(axis=0))
    if set(both) != {0, 1}:
        return None
    n1, n0 = both[1][0], both[0][0]
    first, second = np.split((both[0][1] + both[1][1]) / UNIT / (n0 + n1), 2)
    model = Model(first, np.sqrt(np.maximum(second - first**2, 1e-12)))
    k = len(first)

    def moments(x: np.ndarray) -> np.ndarray:
        z = np.rint(model.scaled(x) * COARSE)  # whole numbers, exact in the product
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()]).astype(np.int64)

    m1, m0 = ((s[:k] / COARSE / n, s[k:].reshape(k, k) / COARSE**2 / n) for n, s in map(_sums(rows, moments).get, (1, 0)))
    cross = np.outer(m1[0], m0[0])
    curve = np.linalg.inv((m1[1] + m0[1] - cross - cross.T) / 4 + DECAY * np.eye(k))
    model.weights = np.zeros(k)

    def by_strength(x: np.ndarray) -> np.ndarray:
        s = np.clip(model.strength(x), -REACH, REACH)
        b = np.minimum(((s + REACH) * (BINS / (2 * REACH))).astype(np.int64), BINS - 1)
        out = np.zeros((BINS, k + 2), np.int64)
        np.add.at(out, b, np.column_stack([np.ones(len(x), np.int64), _whole(s, FINE), _whole(model.scaled(x), FINE)]))
        return out.ravel()

    for _ in range(STEPS):
        (c1, s1, z1), (c0, s0, z0) = ((t[:, 0].astype(float), t[:, 1] / FINE / np.maximum(t[:, 0], 1), t[:, 2:] / FINE) for t in (v[1].reshape(BINS, k + 2) for v in map(_sums(rows, by_strength).get, (1, 0))))
        lost = 1 / (1 + np.exp(s1[:, None] - s0))  # of each pair: the chance given to the wrong order
        g = ((z1 * (lost @ c0)[:, None]).sum(axis=0) - (z0 * (c1 @ lost)[:, None]).sum(axis=0)) / (n1 * n0) - DECAY * model.weights
        model.weights = np.round(model.weights + curve @ g, 6)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(model.strength(_matrix(batch.column("x"))))], names=["y", "s"])

    s = saved(rows.mapInArrow(strengths, "y int, s double"), "strengths")
    # as many training rows as have label 0 lie below the cut, which lies mid-gap
    model.at = (_ranked(s, n0 - 1) + _ranked(s, n0)) / 2
    spread = max(_ranked(s.where("y = 1"), (n1 - 1) // 2) - _ranked(s.where("y = 0"), (n0 - 1) // 2), 1e-6)
    model.slope = 8.0 / spread
    return model


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (measures) of every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                x = measures(piece.column("_text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, MEASURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), lists], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return saved(rows.mapInArrow(run, f"id {kind}, x array<double>"), "measures")


def predict(rows: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """id_col, score, predicted of measured rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = sent.value
            score = np.full(batch.num_rows, 0.5) if m is None else m.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels of which crc32(id) mod 5 is not 0."""
    known = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("y")).where(~held_out("_k", 5, 0) & F.col("y").isin(0, 1)).distinct()
    rows = measured(docs, id_col, text_col)
    model = train(saved(rows.join(known, F.col("id") == F.col("_k")).select("y", "x"), "training"))
    return predict(rows, model, id_col).select(id_col, held_out(id_col, 5, 0).alias("held_out"), "score", "predicted")
