"""Interaction of text filters: what each removes alone, after others, and over all orders.

Every whole text is scanned once in its Arrow buffer: byte classes and prefix sums count words, capitals, code points and
symbols; word hashes are sorted within each document, words of one hash are compared by their bytes,
and what is left are the distinct words. A text ends as four bits of a mask and a digest of its bytes.
The fifth bit, a copy of a text with a smaller id, is a minimum of ids by digest. All orders of the filters then
read the counts of masks, at most 32 a part and label, never the documents again.

Copies are counted before they are shuffled: by (digest, part, labels, id) first, whose ids spread any group of copies, then by
digest with partial sums. Nothing is collected; the orders are a fixed table of 600 rows that each mask explodes.

A null text is an empty one (0 words: A and not B, C or D). A null part is ''. A document of null id is counted; as nothing is
smaller than null or null smaller than anything, it is no copy and makes none. Rows of one id and text are no copies of each other; repeated
rows all count. Repeated labels: the largest counts; rows without a label are neither good nor toxic. An empty table gives no
rows. Extra columns are ignored. A very long text stands alone in its piece and takes time n log n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exact
from . import words as W
from .store import quoted

FILTERS = "ABCDE"
_UPPER, _MARK, _LEAD = (np.zeros(256, np.int64) for _ in range(3))
_UPPER[65:91] = 1
_MARK[list(b"#$%&*|")] = 1
_LEAD[:128] = _LEAD[192:] = 1  # all but the later bytes of a code point


@dataclass(frozen=True)
class Limits:
    """A: fewer words; B: fewer distinct words, in percent; C: more capitals, in percent of code points; D: any mark."""

    min_words: int = 200
    min_distinct: int = 50
    max_capitals: int = 3


def distinct_words(ws: W.Words) -> np.ndarray:
    """Distinct words of each document."""
    n = len(ws.start)
    if not n:
        return np.zeros(len(ws.first) - 1, np.int64)
    hashes = ws.hashes()
    doc = np.repeat(np.arange(len(ws.first) - 1), ws.counts)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (d[1:] == d[:-1])])
    bad = exact.differ(ws, order[1:][again[1:]], order[:-1][again[1:]])
    out = np.bincount(d[~again], minlength=len(ws.first) - 1)
    for x in np.unique(d[1:][again[1:]][bad]).tolist():  # two words of one hash
        out[x] = len({ws.word(i) for i in range(ws.first[x], ws.first[x + 1])})
    return out


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points, marks of each text; a null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ws = W.tokenize(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    off = off - off[0]

    def per(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table[ws.data])])
        return upto[off[1:]] - upto[off[:-1]]

    return {"words": ws.counts, "distinct": distinct_words(ws), "capitals": per(_UPPER), "points": per(_LEAD), "marks": per(_MARK)}


def _masks(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                texts = piece.column("_text")
                c = counts(texts)
                mask = (c["words"] < limits.min_words) * 1 + (100 * c["distinct"] < limits.min_distinct * c["words"]) * 2 + (100 * c["capitals"] > limits.max_capitals * c["points"]) * 4 + (c["marks"] > 0) * 8
                sums = [hashlib.blake2b(t.as_buffer() or b"", digest_size=16).digest() for t in texts.cast(pa.large_binary()).fill_null(b"")]
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_part"), pa.array(mask, pa.int32()), pa.array(sums, pa.binary())], names=["_id", "_part", "_mask", "_digest"])

    return run


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """_id, _part, _mask (bits of A to D), _digest (128 bits of the text) of every row."""
    part = F.coalesce(docs[quoted(part_col)].cast("string"), F.lit("")) if part_col else F.lit("")
    df = docs.select(docs[quoted(id_col)].alias("_id"), part.alias("_part"), docs[quoted(text_col)].alias("_text"))
    out = T.StructType([df.schema["_id"], T.StructField("_part", T.StringType()), T.StructField("_mask", T.IntegerType()), T.StructField("_digest", T.BinaryType())])
    return df.mapInArrow(W.lean(_masks(limits)), out)


def profile(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str | None = "lang", limits: Limits = Limits()) -> DataFrame:
    """part, mask (bits of A to E), good, toxic, n: how many documents fail which filters."""
    df = masks(docs, id_col, text_col, part_col, limits)
    if labels is None:
        df = df.withColumns({"_good": F.lit(False), "_toxic": F.lit(False)})
    else:
        marks = labels.where(labels[quoted(id_col)].isNotNull()).groupBy(labels[quoted(id_col)].alias("_l")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        df = df.join(marks, F.col("_id") == F.col("_l"), "left").select("_id", "_part", "_mask", "_digest", F.expr("coalesce(q = 1, false)").alias("_good"), F.expr("coalesce(t = 1, false)").alias("_toxic"))
    # equal texts have equal masks, so a group of copies differs by part and labels alone
    rows = df.groupBy("_digest", "_mask", "_part", "_good", "_toxic", "_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = rows.groupBy("_digest", "_mask", "_part", "_good", "_toxic").agg(
        F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("free"), F.sum(F.when(F.col("_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("n"))).alias("least")
    )
    least = F.first("least").over(Window.partitionBy("_digest").orderBy("least"))
    kinds = kinds.withColumn("_first", least["_id"]).withColumn("_own", F.when(F.col("least")["_id"] == F.col("_first"), F.col("least")["n"]).otherwise(0) + F.col("free"))
    copies = F.col("free") + F.col("named") - F.col("_own")
    split = F.explode(F.array(F.struct(F.col("_mask").alias("mask"), F.col("_own").alias("n")), F.struct(F.col("_mask").bitwiseOR(16).alias("mask"), copies.alias("n"))))
    flat = kinds.select("_part", "_good", "_toxic", split.alias("x"))
    return flat.groupBy(F.col("_part").alias("part"), "x.mask", F.col("_good").alias("good"), F.col("_toxic").alias("toxic")).agg(F.sum("x.n").alias("n"))


def _orders() -> list[tuple[str, int, int, int, int]]:
    """(order, step, bit of the step's filter, bits before it, filters) of every order and step."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            out.append((name, step, 1 << k, before))
            before |= 1 << k
    return out


def audit(profiles: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row a part, order and step."""
    listed = F.expr("array(" + ", ".join(f"named_struct('o', '{o}', 's', {s}, 'b', {b}, 'p', {p})" for o, s, b, p in _orders()) + ")")
    df = profiles.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"))
    df = df.select("part", "mask", "n", "g", "t", F.explode(listed).alias("x"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("x.b")) != 0, F.col("mask").bitwiseAND(F.col("x.p")) != 0
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    df = df.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").cast("int").alias("step"), F.col("x.b").alias("b")).agg(
        total(~fails & ~earlier, "n").alias("kept"), total(fails & ~earlier, "n").alias("removed"), total(fails & earlier, "n").alias("redundant"), total(F.col("mask") == F.col("x.b"), "n").alias("unique_fails"),
        total(fails & ~earlier, "g").alias("good_lost"), total(fails & ~earlier, "t").alias("toxic_lost"),
    )
    return df.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "b")).cast("long")).drop("b")
