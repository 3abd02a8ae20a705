"""Retrieval composed from the routes: text, metadata, fusion, caps, fallback, packs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S

TEXT_POOL, META_POOL, PER_SOURCE = 120, 60, 3


def text_route(rows: DataFrame, key: str, text: str, query: str, pool: int = TEXT_POOL) -> DataFrame:
    """key, list, rank, position: rows with every content term by BM25, then rows with half of them or more."""
    wanted = [t for t in S._tokens(query) if t not in T.STOP_WORDS] or S._tokens(query)
    strict = S.top(S.bm25(rows, key, text, wanted, True), pool, F.col("score"), F.col(key)).select(key, "rank")
    any_ = S.top(S.bm25(rows, key, text, wanted, False), pool, F.col("score"), F.col(key))
    near = T.apart(rows.select(key, F.size(F.array_intersect(T.terms(T.term_key(F.col(text))), F.array(*[F.lit(t) for t in wanted]))).alias("_n")))
    relaxed = any_.join(near.where((F.col("_n") >= max(1, math.ceil(len(wanted) / 2))) & (F.col("_m") >= 0)).select(key), key).select(key, "rank")
    both = S.union_first(strict, relaxed, key)
    cut = both.orderBy("list", "rank").limit(pool)
    return cut.withColumn("position", F.row_number().over(Window.orderBy("list", "rank")).cast("long"))


def fresh(hits: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Hits whose version is still the current one."""
    return hits.join(current.select(*keys).distinct(), list(keys), "left_semi")


def retrieve(rows: DataFrame, key: str, text: str, source: str, meta: DataFrame, query: str, fields: list[str], limit: int = 10) -> DataFrame:
    """key, source, score, direct, rank: reciprocal rank fusion of both routes, at most PER_SOURCE of a source, cut at ``limit``."""
    direct = text_route(rows, key, text, query).select(key, F.col("position").alias("rank"))
    m = S.metadata_hits(meta, key, query, fields)
    by_meta = S.top(m, META_POOL, F.col("quality"), F.col("priority"), F.col(key)).select(key, "rank")
    fused = S.fuse([direct, by_meta], key).join(direct.select(key, F.lit(True).alias("direct")), key, "left")
    fused = fused.withColumn("direct", F.coalesce("direct", F.lit(False))).join(rows.select(key, source), key)
    order = [F.desc("score"), F.desc("direct"), F.col(key)]
    return S.top(S.capped(fused, source, order, PER_SOURCE), limit, *order).select(key, source, F.round("score", 9).alias("score"), "direct", "rank")


def fallback(hits: DataFrame, base: DataFrame, key: str, *order: Column, pool: int = 50) -> DataFrame:
    """Hits, then the first ``pool`` by order of the base rows whose keys have none."""
    more = base.join(hits.select(key), key, "left_anti").orderBy(*order).limit(pool)
    return hits.select(key, F.lit(1).cast("long").alias("route")).unionByName(more.select(key, F.lit(2).cast("long").alias("route")))


def pack(parts: list[DataFrame], key: str, text: str, most: int = 30, chars: int = 2000) -> DataFrame:
    """key, part, place, excerpt: parts in order of priority, a key once, ``most`` in all, each cut at ``chars``."""
    every = None
    for i, p in enumerate(parts):
        p = p.select(key, text, "rank", F.lit(i).cast("long").alias("part"))
        every = p if every is None else every.unionByName(p)
    once = every.groupBy(key).agg(F.min(F.struct("part", "rank", text)).alias("m")).select(key, "m.part", "m.rank", f"m.{text}")
    cut = once.orderBy("part", "rank", key).limit(most)
    return cut.select(key, "part", F.row_number().over(Window.orderBy("part", "rank", key)).cast("long").alias("place"), F.substring(text, 1, chars).alias("excerpt"))


def share_pack(rows: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """key, content, truncated, tokens: each of a few rows gets an equal share of a budget of tokens of four characters."""
    n = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    share = (F.floor(F.lit(budget * 4) / F.col("_n")) * 4).cast("int")
    cut = rows.select(key, text).crossJoin(F.broadcast(n)).withColumn("content", F.col(text).substr(F.lit(1), share))  # one row
    return cut.select(key, "content", (F.length(text) > F.length("content")).alias("truncated"), F.floor(F.length("content") / 4).cast("long").alias("tokens"))


def pending_page(rows: DataFrame, owner: str, order: list[str], size: str, most: int = 24_000, items: int = 20) -> DataFrame:
    """The next open parts of each owner within a budget of characters and items; the first always fits."""
    w = Window.partitionBy(owner).orderBy(*order)
    run = rows.withColumn("place", F.row_number().over(w).cast("long")).withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return run.where((F.col("place") == 1) | ((F.col("running") <= most) & (F.col("place") <= items)))
