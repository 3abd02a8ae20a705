"""Bounded, seeded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved


#: A sample holds at most this many labels (the most frequent), and texts of at most this many characters.
MAX_LABELS = 64
MAX_CHARS = 50_000


def texts_of(rows: DataFrame, picked: DataFrame, id_col: str, text_col: str, label: Column | None = None) -> list[tuple]:
    """(id, label, text) of the rows of ``picked`` (_i, _l; a bounded number), in one job; null and overlong texts are left out.

    One text a picked (id, label) is fetched, however many rows share it: that of the least digest. ``label``: leaves out rows that bear another label than their id was picked for."""
    found = rows.join(F.broadcast(picked), F.col(id_col) == F.col("_i")).where(F.length(text_col) <= MAX_CHARS)
    found = found.where((label if label is not None else F.col("_l")) == F.col("_l"))
    found = found.groupBy("_i", "_l").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col))).alias("_t"))
    return sorted((r[0], r[1], r[2]) for r in found.collect())


def by_label(rows: DataFrame, id_col: str, text_col: str, label: Column, most: int, seed: int = 5) -> list[tuple]:
    """(id, label, text) of up to ``most`` rows of each label: the least of each of ``most`` hash buckets.

    Ids are chosen by a partial aggregation; only their texts are then fetched. Sorted by id."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    picked = rows.select(F.col(id_col).alias("i"), label.alias("l"), h.alias("h")).where("i is not null and l is not null")
    picked = picked.groupBy("l", F.pmod("h", F.lit(most)).alias("b")).agg(F.min(F.struct("h", "i")).alias("x"), F.count("*").alias("c"))
    picked = saved(picked.select(F.col("x.i").alias("_i"), F.col("l").alias("_l"), "c"), "sample")
    top = picked.groupBy("_l").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "_l").limit(MAX_LABELS)
    return texts_of(rows, picked.join(F.broadcast(top), "_l", "left_semi"), id_col, text_col, label)


def within(samples: list[tuple], chars: int) -> list[tuple]:
    """The (id, label, text) rows in order, each label's as long as its share of ``chars`` characters lasts; a longer text is passed over."""
    labels = {s[1] for s in samples}
    left, out = {y: chars // len(labels) for y in labels}, []
    for s in samples:
        if len(s[2]) <= left[s[1]]:
            left[s[1]] -= len(s[2])
            out.append(s)
    return out


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
