"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size). For each source the budget is met by whole documents:
every size class gives the same share, then a bounded-knapsack dynamic program over the sizes left
fits the remaining words, and a seeded hash order picks that many documents of each size. Text is
read once to count words; only (id, source, size) rows are shuffled. A size class is ranked in
slices of its hash order, so one source or size never lands in one task; rows of one id, source and size
share a slice.

Null text has size 0; a null source is a source of its own, last in weight order. Documents of size
0 take 0. Equal rows are interchangeable. An empty table gives an empty result. Extra columns are ignored by
``mix`` and kept by ``mixed``, whatever their names. One row a source is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import quoted, saved

WEIGHTS = (5, 2, 1)
#: Words that the dynamic program fits at most; the budget above is met by whole size classes.
FIT_WORDS = 200_000
SLICES = 4096
#: Sources of which the targets are broadcast; of more they are joined.
MAX_SENT = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: float = 2.0) -> list[float]:
    """Words to take from each source: shares by weight, stopped at ``most`` times the source, the excess reshared."""
    n = len(sizes)
    own = [weights[i % len(weights)] for i in range(n)]
    left, scale, out = sum(sizes) * percent / 100, sum(own), [0.0] * n
    # the source that stops at the least share a unit of weight stops first
    order = sorted(range(n), key=lambda i: most * sizes[i] / own[i])
    for k, i in enumerate(order):
        if left * own[i] <= most * sizes[i] * scale:
            for j in order[k:]:
                out[j] = left * own[j] / scale
            break
        out[i] = most * sizes[i]
        left, scale = left - out[i], scale - own[i]
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to pick so that the words come as near below ``budget`` as whole documents can.

    A share of every class first, then large to small down to FIT_WORDS, then exact dynamic programming.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    picked = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((sizes * picked).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order.tolist():
        if left <= FIT_WORDS:
            break
        k = min(int(counts[i] - picked[i]), (left - FIT_WORDS // 2) // int(sizes[i]) if sizes[i] else 0)
        if k > 0:
            picked[i] += k
            left -= k * int(sizes[i])
    # bounded knapsack in parts of 1, 2, 4, ... of a size: which part first made each sum
    parts: list[tuple[int, int, int]] = []
    made = np.full(left + 1, -1, np.int32)
    reach = np.zeros(left + 1, np.bool_)
    reach[0] = True
    for i in order.tolist():
        size, spare = int(sizes[i]), int(counts[i] - picked[i])
        spare = min(spare, left // size) if size else 0
        k = 1
        while spare > 0 and not reach[left]:
            k = min(k, spare)
            new = np.flatnonzero(reach[: left + 1 - k * size] & ~reach[k * size :]) + k * size
            made[new], reach[new] = len(parts), True
            parts.append((i, k, k * size))
            spare -= k
            k *= 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k, w = parts[made[at]]
        picked[i] += k
        at -= w
    return picked


def sized(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and _size: the number of words of the whole text (null: 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                cols = [piece.column(f.name) for f in piece.schema if f.name != "_text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(W.tokenize(piece.column("_text")).counts, pa.int64())], names=[f.name for f in piece.schema if f.name != "_text"] + ["_size"])

    df = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != "_text")
    return df.mapInArrow(W.lean(count), fields + "_size long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, seed: int = 17, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and ``extra`` (columns of docs by name) for every document.

    taken is 0, size or 2 * size. One row per source is collected to set targets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_t"), *[c.alias(k) for k, c in (extra or {}).items()])
    rows = sized(rows, "_t", ("_id", "_source", *(extra or ())))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"))).withColumn("_slice", F.shiftrightunsigned("_order", 52))
    rows = saved(rows, "mix")
    counted = rows.groupBy("_source", "_size", "_slice").agg(F.count("*").alias("_n"))
    counted = saved(counted, "mix-counts")
    by_size = counted.groupBy("_source", "_size").agg(F.sum("_n").alias("_n"))
    sums = {r[0]: int(r[1]) for r in by_size.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n"))).collect()}
    names = sorted((s for s in sums if s is not None), key=lambda s: [ord(c) for c in str(s)]) + [s for s in sums if s is None]
    aims = dict(zip(names, targets([sums[s] for s in names], weights, percent)))
    kind = docs.schema[source_col].dataType.simpleString()
    aim = spark.createDataFrame([(s, sums[s], float(aims[s])) for s in names], f"_source {kind}, source_size long, target double")
    small = F.broadcast if len(names) <= MAX_SENT else lambda x: x

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = int(target // size) if size else 0
        rounds = min(rounds, 2)
        k = fit(group["_size"].to_numpy(), group["_n"].to_numpy(), int(round(target)) - rounds * size)
        return group[["_source", "_size"]].assign(_k=k, _rounds=rounds)

    joined = by_size.join(small(aim), by_size["_source"].eqNullSafe(aim["_source"])).drop(aim["_source"])
    picks = joined.groupBy("_source").applyInPandas(choose, f"_source {kind}, _size long, _k long, _rounds long")
    # of each size the first _k by hash order: whole slices below the cut, and a rank inside the slice that holds it
    from pyspark.sql import Window as Win

    # what lies below a slice: in its run of 64 slices, and in the runs before; no window is longer than 64 rows
    counted = counted.withColumn("_run", F.shiftright("_slice", 6))
    upto = lambda *keys: Win.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Win.unboundedPreceding, -1)
    long = counted.groupBy("_source", "_size", "_run").agg(F.sum("_n").alias("_n"))
    long = long.withColumn("_before", F.coalesce(F.sum("_n").over(upto("_source", "_size", "_run")), F.lit(0)))
    long = long.join(picks.withColumnsRenamed({"_source": "_s", "_size": "_z"}), F.expr("_source <=> _s and _size = _z")).select("_s", "_z", F.col("_run").alias("_r"), "_before", "_k", "_rounds")
    before = counted.withColumn("_below", F.coalesce(F.sum("_n").over(upto("_source", "_size", "_run", "_slice")), F.lit(0)))
    cuts = before.join(long, F.expr("_source <=> _s and _size = _z and _run = _r")).select("_source", "_size", "_slice", "_rounds", F.greatest(F.lit(0), F.least("_n", F.expr("_k - _before - _below"))).alias("_take"), "_n")
    cuts = cuts.withColumnsRenamed({"_source": "_s", "_size": "_z", "_slice": "_l"})
    out = rows.join(cuts, F.expr("_source <=> _s and _size = _z and _slice = _l"))
    whole = out.where("_take = 0 or _take = _n or _size = 0").withColumn("_more", F.when((F.col("_take") > 0) & (F.col("_size") > 0), 1).otherwise(0))
    part = out.where("_take > 0 and _take < _n and _size > 0").withColumn("_more", F.when(F.row_number().over(Win.partitionBy("_s", "_z", "_l").orderBy("_order", "_id", *(extra or ()))) <= F.col("_take"), 1).otherwise(0))
    done = whole.unionByName(part).drop("_s").join(small(aim.withColumnRenamed("_source", "_s")), F.expr("_source <=> _s"))
    return done.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("_rounds") + F.col("_more"))).alias("taken"), *(extra or ()))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the input's columns.

    Rows of one id, source and text (by a 128-bit digest, so of one size) share what the mix takes of them; null ids are an id of their own."""
    from pyspark.sql import Window as Win

    digest = {"_d1": F.xxhash64(F.col(text_col)), "_d2": F.xxhash64(F.lit(1), F.col(text_col))}
    taken = mix(docs, id_col, text_col, source_col, extra=digest, **options).where("size > 0")
    taken = taken.groupBy(F.col(id_col).alias("_mi"), F.col(source_col).alias("_mo"), F.col("_d1").alias("_m1"), F.col("_d2").alias("_m2")).agg(F.sum(F.expr("taken div size")).alias("_mt"), F.count("*").alias("_mk")).where("_mt > 0")
    own = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), *[c.alias(k) for k, c in digest.items()])
    rows = own.join(taken, F.expr("_id <=> _mi and _source <=> _mo and _d1 = _m1 and _d2 = _m2"))
    single = rows.where("_mk = 1 or _mt % _mk = 0").withColumn("_mc", F.expr("_mt div _mk"))
    several = rows.where("not (_mk = 1 or _mt % _mk = 0)")
    several = several.withColumn("_mc", F.expr("_mt div _mk") + F.when(F.row_number().over(Win.partitionBy("_mi", "_mo", "_m1", "_m2").orderBy("_d1")) <= F.expr("_mt % _mk"), 1).otherwise(0))
    done = single.unionByName(several).withColumn("_mc", F.explode(F.expr("if(_mc > 0, sequence(1, _mc), cast(array() as array<bigint>))")))
    return done.select("_row.*")
