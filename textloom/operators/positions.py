"""Exact search whose hits are places in the source text.

Rows never leave their partition: each batch is brought into its position-mapped form, needles (few, held by the
plan; more of them in blocks) are searched in it, and hits are mapped back. Null texts have no hits; an empty table gives an empty result;
a needle without anything but white space, marks and joiners is refused. A very long text takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import mapped

#: Characters of text that are brought into their form at once.
PIECE = 1 << 20
_LONGS = pa.list_(pa.int64())


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts, i = batch.column("text").to_pylist(), 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= PIECE):
            n += len(texts[j] or "")
            j += 1
        yield batch.slice(i, j - i), [t or "" for t in texts[i:j]]
        i = j


def _keyed(rows: DataFrame, key: str, text: str, more: list[tuple[str, T.DataType]]) -> tuple[DataFrame, T.StructType]:
    df = rows.select(rows[f"`{key}`"].alias("key"), rows[f"`{text}`"].alias("text"))
    return df, T.StructType([df.schema["key"], *[T.StructField(n, t) for n, t in more]])


def source_map(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, form, at: the normal form and, for each of its characters, the 0-based place in the text it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch):
                f = mapped.forms(texts)
                known = part.column("text").is_valid()
                at = pa.ListArray.from_arrays(pa.array(f.first, pa.int32()), pa.array(f.at, pa.int32()))
                made = [pa.array([f.text(d) for d in range(len(texts))], pa.string()), at]
                none = [pa.nulls(len(texts), x.type) for x in made]
                import pyarrow.compute as pc

                yield pa.RecordBatch.from_arrays([part.column("key"), *[pc.if_else(known, x, y) for x, y in zip(made, none)]], names=["key", "form", "at"])

    df, out = _keyed(rows, key, text, [("form", T.StringType()), ("at", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, out).withColumnRenamed("key", key)


def find(rows: DataFrame, key: str, text: str, needles: list[str], fold: bool = True, lines: int = 3, before: int = 80, after: int = 120) -> DataFrame:
    """key, needle, hit_count, starts and ends (0-based places in the text, end exclusive), line (of the first hit), lines (first distinct ones), context.

    One row for each text and needle that it holds; hits of a needle do not overlap. Without ``fold`` characters count as they are."""
    wanted = {n: "".join(mapped.forms([n.strip()]).text(0)) if fold else n.strip() for n in dict.fromkeys(needles)}
    if not all(wanted.values()):
        raise ValueError("a needle is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch):
                f, found = mapped.forms(texts, fold), []
                for d, source in enumerate(texts):
                    form = f.text(d) if fold else source
                    at, breaks = f.at[f.first[d] : f.first[d + 1]], None
                    for name, needle in wanted.items():
                        hits = np.fromiter(mapped.occurrences(form, needle), np.int64)
                        if len(hits):
                            if breaks is None:
                                breaks = np.flatnonzero(np.frombuffer(source.encode("utf-32-le", "surrogatepass"), "<u4") == 10)
                            start, end = at[hits], at[hits + len(needle) - 1] + 1
                            own = list(dict.fromkeys((np.searchsorted(breaks, start) + 1).tolist()))
                            first = int(start[0])
                            around = source[max(0, first - before) : first + len(name.strip()) + after].replace("\n", " ")
                            found.append((d, name, len(hits), start.tolist(), end.tolist(), own[0], own[:lines], around))
                cols = list(zip(*found)) if found else [()] * 8
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], _LONGS), pa.array(cols[4], _LONGS), pa.array(cols[5], pa.int64()), pa.array(cols[6], _LONGS), pa.array(cols[7], pa.string())],
                    names=["key", "needle", "hit_count", "starts", "ends", "line", "lines", "context"],
                )

    longs = T.ArrayType(T.LongType())
    df, out = _keyed(rows, key, text, [("needle", T.StringType()), ("hit_count", T.LongType()), ("starts", longs), ("ends", longs), ("line", T.LongType()), ("lines", longs), ("context", T.StringType())])
    return df.mapInArrow(run, out).withColumnRenamed("key", key)
