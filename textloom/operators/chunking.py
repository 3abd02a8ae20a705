"""Deterministic chunking of texts into half-open code-point spans, and checks of a chunk table.

A text of at most SOFT characters is one chunk. A longer one is cut where blocks begin: at headings, behind blank
lines, at a table's first line, behind front matter. Blocks over HARD are cut again behind the last sentence that
ends within SOFT (with the white space behind it if all of that fits), else at SOFT, never inside CR LF. Pieces
are put together up to SOFT; a last chunk under TAIL joins the one before if both stay within HARD.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

# Soft and hard length, least tail, version; marks that end a sentence, white space behind them.
SOFT, HARD, TAIL, VERSION = 4000, 6000, 400, "chunk-1"
ENDS = ".!?؟۔…\n"
SPACES = " \t\r\n\x0b\x0c\x85\xa0\u2028\u2029"
#: Rows whose texts a worker holds at a time.
FEW = 64

_HEADING = re.compile(r"^(#{1,6}) ([^\n]*)", re.M)
_BEHIND_BLANKS = re.compile(r"^(?:[ \t\r]*\n)+(?=[ \t\r]*[^ \t\r\n])", re.M)
_TABLE = re.compile(r"^(?:[ \t]*\|[^\n]*(?:\n|\Z))+", re.M)
_MATTER = re.compile(r"---\r*\n(?:[^\n]*\n)*?---\r*(?:\n|\Z)")


def block_starts(text: str) -> list[int]:
    """Offsets where a block begins."""
    matter = _MATTER.match(text)
    starts = {0} | {m.start() for r in (_HEADING, _TABLE) for m in r.finditer(text)} | {m.end() for m in _BEHIND_BLANKS.finditer(text)}
    return sorted((starts | ({matter.end()} if matter else set())) - {len(text)})


def cut_long(block: str) -> list[int]:
    """Ends of the pieces of a block, all but the last."""
    code = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(code)
    space = np.append(np.isin(code, [ord(c) for c in SPACES]), True)
    ends = np.flatnonzero(np.isin(code, [ord(c) for c in ENDS]) & space[1:]) + 1
    # the first place from each one on that is not white space
    solid = np.minimum.accumulate(np.where(space[:n], n, np.arange(n))[::-1])[::-1]
    behind = np.append(solid, n)[ends]
    out, at = [], 0
    while n - at > SOFT:
        limit = at + SOFT
        k = int(np.searchsorted(ends, limit, "right")) - 1
        if k >= 0 and ends[k] > at + 1:
            at = int(behind[k] if behind[k] <= limit else ends[k])
        else:
            at = limit + (block[limit - 1 : limit + 1] == "\r\n")
        out.append(at)
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every chunk."""
    n = len(text)
    if n <= SOFT:
        return [(0, n)] if n else []
    starts = block_starts(text)
    bounds = sorted({x for a, b in zip(starts, [*starts[1:], n]) for x in ([a] + ([a + c for c in cut_long(text[a:b])] if b - a > HARD else []))} | {n})
    cuts, k = [0], 0
    while cuts[-1] < n:  # the farthest bound within reach, or the next one
        k = max(bisect_right(bounds, cuts[-1] + SOFT) - 1, k + 1)
        cuts.append(bounds[k])
    if len(cuts) > 2 and n - cuts[-2] < TAIL and n - cuts[-3] <= HARD:
        del cuts[-2]
    return list(zip(cuts, cuts[1:]))


def heading_paths(text: str, starts: list[int]) -> list[list[str]]:
    """Headings in force at each of the ascending offsets."""
    force: dict[int, str] = {}
    out, heads = [], [(m.start(), len(m[1]), m[2].strip()[:120]) for m in _HEADING.finditer(text)]
    for a, b in zip([-1, *starts], starts):
        for _, level, title in heads[bisect_right(heads, (a, 7)) : bisect_right(heads, (b, 7))]:
            force = {v: t for v, t in force.items() if v < level} | {level: title}
        out.append([force[v] for v in sorted(force)])
    return out


def chunks(rows: DataFrame, key: str, text: str, version: Column | None = None, with_text: bool = True) -> DataFrame:
    """key, idx, start_char, end_char, heading_path, text (unless not asked for, and ``version`` of the whole text) of every chunk; one pass, no shuffle.

    A worker holds the texts of FEW rows at a time as objects, not those of a whole batch, and writes no texts that nobody asked for."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FEW):
                batch = whole.slice(at, FEW)
                owner, out = [], []
                for i, t in enumerate(batch.column("t").to_pylist()):
                    found = spans(t or "")
                    paths = heading_paths(t, [a for a, _ in found]) if len(found) > 1 else [[]] * len(found)
                    owner += [i] * len(found)
                    out += [(k, a, b, path, t[a:b] if with_text else None) for k, ((a, b), path) in enumerate(zip(found, paths))]
                pick, (idx, start, end, path, part) = pa.array(owner, pa.int64()), zip(*out) if out else [()] * 5
                columns = [batch.column("k").take(pick), pa.array(idx, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(path, pa.list_(pa.string()))]
                columns += ([pa.array(part, pa.string())] if with_text else []) + [batch.column("v").take(pick)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "idx", "start_char", "end_char", "heading_path", *(["text"] if with_text else []), "version"])

    source = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.lit(None) if version is None else version).cast("string").alias("v"))
    text_kind = "text string, " if with_text else ""
    done = source.mapInArrow(run, f"k {kind}, idx long, start_char long, end_char long, heading_path array<string>, {text_kind}version string").withColumnRenamed("k", key)
    return done.drop("version") if version is None else done


def linked(rows: DataFrame, key: str, order: str, ref: str) -> DataFrame:
    """prev_ref and next_ref inside a key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("prev_ref", F.lag(ref).over(w)).withColumn("next_ref", F.lead(ref).over(w))


def with_refs(rows: DataFrame, key: str, layer: str = "body") -> DataFrame:
    """chunk_digest and chunk_ref of chunk rows with their text's version."""
    digest = ids.chunk_digest(F.col(key).cast("string"), F.col("version"), F.lit(layer), F.col("start_char"), F.col("end_char"), F.lit(VERSION))
    return rows.withColumn("chunk_digest", digest).withColumn("chunk_ref", F.concat(F.lit("chk:"), F.substring("chunk_digest", 1, 32)))


def invariants(rows: DataFrame, chunked: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_chars, n_chunks where small, and whether the partition of the text holds: starts at 0, no gap or overlap, ends at its length, none over HARD."""
    w = Window.partitionBy(key).orderBy("idx")
    c = chunked.withColumn("_prev", F.lag("end_char").over(w))
    c = c.groupBy(key).agg(
        F.count("*").alias("n"), F.min("start_char").alias("a"), F.max("end_char").alias("b"),
        F.max((F.coalesce("_prev", F.lit(0)) != F.col("start_char")).cast("int")).alias("torn"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"),
    )
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    out = rows.select(key, size.alias("n_chars")).join(c, key, "left")
    holds = F.when(F.col("n_chars") == 0, F.col("n").isNull()).otherwise((F.col("a") == 0) & (F.col("b") == F.col("n_chars")) & (F.col("torn") == 0) & (F.col("longest") <= HARD))
    small = F.when(F.col("n_chars") <= SOFT, F.coalesce("n", F.lit(0))).cast("long")
    return out.select(key, "n_chars", small.alias("chunks_if_small"), F.coalesce(holds, F.lit(False)).alias("holds"))
