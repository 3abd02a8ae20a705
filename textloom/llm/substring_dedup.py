"""Substring dedup by fixed-block anchors.

A repeated window of 20 words holds, in its earlier document, a whole block of 10 words at a multiple of
10. So (1) the non-overlapping blocks of every document are indexed in a bitmap; (2) every rolling
10-word window that the bitmap knows is sent, once a task, to the bucket of its hash, where a block with a
second occurrence anywhere is an anchor; (3) hits are extended: every 20-word window over an anchor is
hashed, all but the first of a task are repeats at once, the first ones meet in the bucket of their hash and
all but the earliest are repeats; overlapping repeats make up maximal exact repeats; (4) documents drop the
words of repeats.

The bitmaps have eight bits a block, 2 ** FILTER_BITS at most; a full one only lets more windows
through to the exact steps. A window that occurs n times is sent once a task, so hot passages stay small,
and nothing is paired with anything. Tasks hold one bucket at a time. Windows compare by 96 bits of two
independent hashes.

Null and empty texts have no words. Texts of under 20 words lose nothing. Rows of one id and text are one
document: they are kept alike. Different texts of one id are different documents, in the order of their
64-bit digests. Ids that are no integers come in the order of their type (strings by bytes), by their places among all ids; a null id comes after all others. An
empty table gives an empty result; extra columns are ignored by ``digests`` and kept, whatever their names, by ``remove``. A very long text
stands alone in its piece; time and memory follow its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packing import running
from . import words as W
from .store import quoted, saved

WINDOW = 20
ANCHOR = 10
#: Bits of a bitmap's address at most (and at least FEWEST_BITS).
FILTER_BITS = 28
FEWEST_BITS = 18
SLICES = 64
#: Bytes of text whose windows share a row a bucket.
PIECE = 2 << 20
#: Windows that a task holds before it sends them: repeats among first ones need not travel, late ones share rows.
HELD = 1_000_000
_LAST = np.iinfo(np.int64).max
_PACKED = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])


def filter_bits(rows: DataFrame) -> int:
    """Address bits of a bitmap for the blocks of all texts, reckoned from their characters."""
    chars = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    return min(FILTER_BITS, max(FEWEST_BITS, int(chars // 8).bit_length()))


def _bits(cells: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Cells of a bitmap by slice, packed."""
    cells = np.unique(cells)
    size = (1 << bits) // SLICES
    bounds = np.searchsorted(cells, np.arange(SLICES + 1, dtype=np.uint64) * np.uint64(size))
    for s in range(SLICES):
        if bounds[s] < bounds[s + 1]:
            yield s, (cells[bounds[s] : bounds[s + 1]] - np.uint64(s * size)).astype("<u4").tobytes()


def _cells(hashes: np.ndarray, bits: int, second: bool = False) -> np.ndarray:
    return (W.mix(hashes + np.uint64(77)) if second else hashes) >> np.uint64(64 - bits)


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], schema=_PACKED)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of each bucket; rows come sorted by it, so one bucket is held at a time."""
    now, held = None, []
    for batch in batches:
        for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(raw.as_py())
    if held:
        yield now, held


def _bitmap(rows: DataFrame, bits: int):
    """Broadcast of a whole bitmap: 2 ** bits bits are collected, a bounded size."""
    size = (1 << bits) // SLICES

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, parts in _buckets(batches):
            m = np.zeros(size, np.bool_)
            for raw in parts:
                m[np.frombuffer(raw, "<u4")] = True
            yield _rows([(s, np.packbits(m, bitorder="little").tobytes())])

    merged = saved(_dealt(rows, SLICES).mapInArrow(merge, "bucket int, packed binary"), "bitmap")
    parts = {r[0]: bytes(r[1]) for r in merged.collect()}
    empty = bytes(size // 8)
    return rows.sparkSession.sparkContext.broadcast(b"".join(parts.get(i, empty) for i in range(SLICES)))


def _known(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _blocks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "_text", limit=PIECE):
                ws = W.tokenize(piece.column("_text"))
                hashes, at, owner = _anchors(ws)
                own = (at - ws.first[owner]) % ANCHOR == 0
                yield _rows(list(_bits(_cells(hashes[own], bits), bits)))

    return run


def _anchors(ws: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, at = ws.windows(ws.hashes(), ANCHOR)
    return hashes, at, np.searchsorted(ws.first, at, "right") - 1


def _split(order_key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (order_key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _probes(index, buckets: int, bits: int):
    """Hashes of windows that a block may equal; low bits: is a block, seen twice in this piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(index.value, np.uint8)
        for batch in batches:
            for piece in W.pieces(batch, "_text", limit=PIECE):
                ws = W.tokenize(piece.column("_text"))
                hashes, at, owner = _anchors(ws)
                own = (at - ws.first[owner]) % ANCHOR == 0
                hit = own | _known(bitmap, _cells(hashes, bits))
                key = hashes[hit] & ~np.uint64(3)
                distinct, back, count = np.unique(key, return_inverse=True, return_counts=True)
                flags = np.zeros(len(distinct), np.uint64)
                flags[back[own[hit]]] = 1
                sent = distinct | flags | np.where(count > 1, np.uint64(2), np.uint64(0))
                order, bounds = _split(distinct >> np.uint64(2), buckets)
                sent = sent[order].astype("<u8")
                yield _rows([(b, sent[bounds[b] : bounds[b + 1]].tobytes()) for b in range(buckets) if bounds[b] < bounds[b + 1]])

    return run


def _live(bits: int):
    """Cells of blocks that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _buckets(batches):
            x = np.sort(np.frombuffer(b"".join(parts), "<u8"))
            key = x & ~np.uint64(3)
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            flags = np.bitwise_or.reduceat(x & np.uint64(3), heads)
            count = np.diff(np.append(heads, len(x)))
            live = key[heads][((flags & np.uint64(1)) == 1) & ((count > 1) | (flags >= 2))]
            if len(live):
                yield _rows(list(_bits(np.concatenate([_cells(live, bits), _cells(live, bits, True)]), bits)))

    return run


def _windows(anchors, buckets: int, bits: int):
    """(bucket, windows) of the first window of each kind over an anchor, and (below 0, places) of the others."""

    def over_anchors(piece: pa.RecordBatch, bitmap: np.ndarray) -> np.ndarray:
        ws = W.tokenize(piece.column("_text"))
        ids, texts = piece.column("_key").to_numpy(), piece.column("_x").to_numpy()
        h = ws.hashes()
        hashes, at = ws.windows(h, ANCHOR)
        key = hashes & ~np.uint64(3)
        hit = _known(bitmap, _cells(key, bits))
        hit[hit] = _known(bitmap, _cells(key[hit], bits, True))
        upto = np.zeros(len(ws.start) + 1, np.int32)
        upto[at[hit] + 1] = 1
        upto = np.cumsum(upto, dtype=np.int32)
        full, first = ws.windows(h, WINDOW)
        use = upto[first + ANCHOR] > upto[first]  # an anchor starts at one of the first ten words
        full, first = full[use], first[use]
        doc = np.searchsorted(ws.first, first, "right") - 1
        out = np.zeros(len(full), _WINDOW)
        out["h"], out["id"], out["x"], out["at"] = full, ids[doc], texts[doc], first - ws.first[doc]
        out["c"] = W.runs(ws.hashes(1), WINDOW)[first].astype(np.uint32)
        return out

    def sent(x: np.ndarray) -> pa.RecordBatch:
        first, late = _earliest(x)
        order, bounds = _split(first["h"], buckets)
        first = first[order]
        rows = [(b, first[bounds[b] : bounds[b + 1]].tobytes()) for b in range(buckets) if bounds[b] < bounds[b + 1]]
        return _rows(rows + _late_rows(late, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(anchors.value, np.uint8)
        held: list[np.ndarray] = []
        for batch in batches:
            for piece in W.pieces(batch, "_text", limit=PIECE):
                held.append(over_anchors(piece, bitmap))
                if sum(map(len, held)) >= HELD:
                    yield sent(np.concatenate(held))
                    held = []
        if held:
            yield sent(np.concatenate(held))

    return run


_WINDOW = np.dtype([("h", "<u8"), ("id", "<i8"), ("x", "<i8"), ("c", "<u4"), ("at", "<u4")])


def _earliest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest window of each kind, and all that are later than it."""
    x = x[np.lexsort((x["at"], x["x"], x["id"], x["c"], x["h"]))]
    new = np.ones(len(x), np.bool_)
    new[1:] = (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])
    first = x[new]
    lead = np.cumsum(new) - 1
    return first, x[(x["id"] != first["id"][lead]) | (x["x"] != first["x"][lead]) | (x["at"] != first["at"][lead])]


_PLACE = np.dtype([("id", "<i8"), ("x", "<i8"), ("at", "<u4")])


def _late_rows(late: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Places of later windows by a bucket of their documents, numbered from -1 down."""
    places = np.zeros(len(late), _PLACE)
    places["id"], places["x"], places["at"] = late["id"], late["x"], late["at"]
    order, bounds = _split(W.mix(places["id"].astype(np.uint64) ^ W.mix(places["x"].astype(np.uint64))), buckets)
    places = places[order]
    return [(-1 - b, places[bounds[b] : bounds[b + 1]].tobytes()) for b in range(buckets) if bounds[b] < bounds[b + 1]]


def _later(buckets: int):
    """Of the first windows of the tasks, all but the earliest; what tasks found themselves passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, held = [], 0
        for b, parts in _buckets(batches):
            if b < 0:
                yield _rows([(b, p) for p in parts])
                continue
            late.append(_earliest(np.frombuffer(b"".join(parts), _WINDOW))[1])
            held += len(late[-1])
            if held >= HELD:
                yield _rows(_late_rows(np.concatenate(late), buckets))
                late, held = [], 0
        if held:
            yield _rows(_late_rows(np.concatenate(late), buckets))

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: the starts of its later windows."""
    for _, parts in _buckets(batches):
        x = np.frombuffer(b"".join(parts), _PLACE)
        x = x[np.lexsort((x["at"], x["x"], x["id"]))]
        heads = np.flatnonzero(np.concatenate([[True], (x["id"][1:] != x["id"][:-1]) | (x["x"][1:] != x["x"][:-1])]))
        bounds = np.append(heads, len(x)).tolist()
        at = np.ascontiguousarray(x["at"])
        starts = [at[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x["id"][heads], pa.int64()), pa.array(x["x"][heads], pa.int64()), pa.array(starts, pa.binary())], names=["id", "x", "_starts"])


def _repeated(starts: bytes | None, n: int) -> np.ndarray:
    """Which of a document's words lie in a repeat."""
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.frombuffer(starts or b"", "<u4").astype(np.int64))
    at = at[at + WINDOW <= n]
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _documents(base: DataFrame) -> DataFrame:
    """base with _key and _x: the document of a row, in the order of documents. Ids that are no integers get their place among all ids."""
    null = F.col("_id").isNull()
    if base.schema["_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        base = base.withColumn("_key", F.col("_id").cast("long"))
    else:
        ids = base.where(~null).select(F.col("_id").alias("_known")).distinct().withColumn("_one", F.lit(1))
        places = saved(running(ids, [], [F.col("_known")], "_one").select("_known", F.col("before").alias("_key")), "places")
        base = base.join(places, F.col("_id") == F.col("_known"), "left").drop("_known")
    digest = F.when(null, F.xxhash64(F.lit(1), "_text")).otherwise(F.xxhash64("_text"))
    return base.withColumns({"_key": F.when(null, F.lit(_LAST)).otherwise(F.col("_key")), "_x": digest})


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """_id, _text, _starts (the starts of repeated windows, packed, null without any); with ``carry`` also _c: a struct of all columns but the text, by place."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    rest = F.struct(F.lit(0).alias("c"), *[docs[quoted(c)].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    base = _documents(docs.select(docs[quoted(id_col)].alias("_id"), docs[quoted(text_col)].alias("_text"), *([rest.alias("_c")] if carry else [])))
    rows = base.select("_key", "_x", "_text")
    bits = filter_bits(rows)
    pair = "bucket int, packed binary"
    index = _bitmap(rows.mapInArrow(_blocks(bits), pair), bits)
    live = _dealt(rows.mapInArrow(_probes(index, buckets, bits), pair), n).mapInArrow(_live(bits), pair)
    anchors = _bitmap(live, bits)
    found = _dealt(rows.mapInArrow(_windows(anchors, buckets, bits), pair), n).mapInArrow(_later(buckets), pair)
    starts = _dealt(found, n).mapInArrow(_starts, "id long, x long, _starts binary")
    return base.join(starts, (F.col("_key") == F.col("id")) & (F.col("_x") == F.col("x")), "left").drop("id", "x", "_key", "_x")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_repeats (maximal runs of removed words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "_text", limit=PIECE):
                ws = W.tokenize(piece.column("_text"))
                raw = ws.data.tobytes()
                removed, sums, runs = [], [], []
                for d, starts in enumerate(piece.column("_starts").to_pylist()):
                    a, b = int(ws.first[d]), int(ws.first[d + 1])
                    gone = _repeated(starts, b - a)
                    removed.append(int(gone.sum()))
                    runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if b > a else 0)
                    lo, hi = ws.start[a:b], ws.end[a:b]
                    if removed[-1]:
                        lo, hi = lo[~gone], hi[~gone]
                    sums.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(lo.tolist(), hi.tolist())])).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(ws.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(runs, pa.int64())], names=["id", "n_words", "n_removed", "kept_sha256", "n_repeats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return marked(docs, id_col, text_col).select("_id", "_text", "_starts").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, n_repeats long").withColumnRenamed("id", id_col)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated words cut; the words left of a cut text are joined by one space."""
    names = docs.columns
    df = marked(docs, id_col, text_col, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for d, starts in enumerate(batch.column("_starts").to_pylist()):
                if starts:
                    ws = W.tokenize(pa.array([texts[d]], pa.string()))
                    texts[d] = ws.join(0, len(ws.start), ~_repeated(starts, len(ws.start))).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "_text" else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    df = df.mapInArrow(run, df.schema)
    return df.select(*[(F.col("_text") if n == text_col else F.col(f"_c.c{k}")).alias(n) for k, n in enumerate(names)])
