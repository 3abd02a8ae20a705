"""Benchmark decontamination: a broadcast hash set of normalised test windows, probed by rolling hashes.

Windows of 13 words (or the whole of a shorter item) of the benchmark are broadcast in blocks of
bounded size; every document is tokenised once per block, its rolling window hashes are looked up,
and each hit is verified word by word. Documents are never shuffled. A benchmark above the bound is
split by item and scanned block after block, with a written table between.

Null and empty texts have no words and no hits. An item of null id or text is left out. Repeated
items count by id; repeated documents get equal rows; extra columns are ignored by ``scan`` and kept by ``decontaminate``, whatever their names.
A very long text stands alone in its piece; time and memory follow its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import quoted, saved

WINDOW = 13
_TABLE_BITS = 22


class _Block:
    """Windows of some items: sorted hashes by window length, and the exact windows with their items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.exact: dict[bytes, set[str]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            ws = W.tokenize(pa.array([text], pa.string()), W.ALNUM, lower=True)
            n = len(ws.start)
            if not n:
                continue
            size = min(n, WINDOW)
            found, at = ws.windows(ws.hashes(), size)
            hashes.setdefault(size, set()).update(found.tolist())
            for i in at.tolist():
                self.exact.setdefault(ws.join(i, i + size), set()).add(item)
        self.sizes = {k: np.array(sorted(v), np.uint64) for k, v in hashes.items()}
        self.tables = {}
        for k, v in self.sizes.items():
            self.tables[k] = np.zeros(1 << _TABLE_BITS, np.bool_)
            self.tables[k][v >> np.uint64(64 - _TABLE_BITS)] = True

    def scan(self, ws: W.Words) -> list[tuple[int, int, set[str]]]:
        """(first word, length, items) of every verified occurrence."""
        out = []
        if not len(ws.start):
            return out
        hashes = ws.hashes()
        for size, known in self.sizes.items():
            found, at = ws.windows(hashes, size)
            maybe = np.flatnonzero(self.tables[size][found >> np.uint64(64 - _TABLE_BITS)])
            near = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
            for i in at[maybe[known[near] == found[maybe]]].tolist():
                if items := self.exact.get(ws.join(i, i + size)):
                    out.append((i, size, items))
        return out


def _scan_with(broadcast, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = broadcast.value
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                ws = W.tokenize(piece.column("_text"), W.ALNUM, lower=True)
                n = piece.num_rows
                marks = {}
                hit = [set(x) for x in piece.column("_items").to_pylist()]
                old = piece.column("_hits").to_pylist()
                found = block.scan(ws)
                owner = np.searchsorted(ws.first, [f[0] for f in found], "right") - 1
                for (i, size, items), d in zip(found, owner.tolist()):
                    hit[d] |= items
                    a, b = ws.first[d], ws.first[d + 1]
                    if d not in marks:
                        marks[d] = np.unpackbits(np.frombuffer(old[d], np.uint8), count=b - a).astype(np.bool_) if old[d] else np.zeros(b - a, np.bool_)
                    marks[d][i - a : i - a + size] = True
                hits = [np.packbits(marks[d]).tobytes() if d in marks else old[d] for d in range(n)]
                items = [sorted(x) for x in hit]
                new = {"_items": pa.array(items, pa.list_(pa.string())), "_hits": pa.array(hits, pa.binary()), "n_words": pa.array(ws.counts, pa.int64())}
                columns = {f.name: new.get(f.name, piece.column(f.name)) for f in piece.schema}
                if last:
                    sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                    total = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in hits]
                    columns |= {"n_hit": pa.array(total, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(sums, pa.string())}
                    columns = {k: v for k, v in columns.items() if k not in ("_items", *(() if "_c" in columns else ("_text", "_hits")))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def _scanned(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, block_chars: int, carry: bool) -> DataFrame:
    """_id, n_words, n_hit, n_items, items_sha256; with ``carry`` also _c (a struct of all columns but the text, by place), _text and _hits."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[quoted(item_col)].cast("string").alias("i"), benchmark[quoted(text_col)].alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    rest = F.struct(F.lit(0).alias("c"), *[docs[quoted(c)].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    df = docs.select(
        docs[quoted(id_col)].alias("_id"), docs[quoted(text_col)].alias("_text"), *([rest.alias("_c")] if carry else []),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("_items"), F.lit(None).cast("binary").alias("_hits"),
    )
    kept = [f for f in df.schema.fields if f.name not in ("_items", *(() if carry else ("_text", "_hits")))]
    out = T.StructType([*kept, T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())])
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        block, last = spark.sparkContext.broadcast(_Block([(r.i, r.t) for r in part.toLocalIterator()])), k + 1 == blocks
        df = df.mapInArrow(W.lean(_scan_with(block, last)), out if last else df.schema)
        if not last:
            df = saved(df, "hits")
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    block_chars bounds the benchmark text that is collected and broadcast at once.
    """
    return _scanned(docs, benchmark, id_col, text_col, item_col, block_chars, False).withColumnRenamed("_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, size_col: str | None = "n_chars") -> DataFrame:
    """The documents that are not contaminated, with the input's columns, whatever their names.

    spans: also cut the remaining hit words out of the kept texts (the words left are joined by one space).
    """
    names = docs.columns
    df = _scanned(docs, benchmark, id_col, text_col, "item_id", 8_000_000, True).where(~F.col("contaminated"))
    if spans:
        df = df.mapInArrow(W.lean(_cut), df.schema)
    out = {n: F.col("_text") if n == text_col else F.col(f"_c.c{k}") for k, n in enumerate(names)}
    if spans and size_col in out:
        out[size_col] = F.length("_text").cast(docs.schema[size_col].dataType)
    return df.select(*[c.alias(n) for n, c in out.items()])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of documents with hits become their other words, as written."""
    for batch in batches:
        texts, hits = batch.column("_text").to_pylist(), batch.column("_hits").to_pylist()
        for d, h in enumerate(hits):
            if h:
                ws = W.tokenize(pa.array([texts[d]], pa.string()), W.ALNUM, lower=True)
                raw = texts[d].encode()
                keep = np.flatnonzero(~np.unpackbits(np.frombuffer(h, np.uint8), count=len(ws.start)).astype(np.bool_))
                texts[d] = b" ".join(raw[ws.start[i] : ws.end[i]] for i in keep).decode()
        yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "_text" else batch.column(f.name) for f in batch.schema], schema=batch.schema)
