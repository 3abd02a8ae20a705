"""Keyword search: postings, BM25, relaxation ladder, exact substrings, metadata rows, fusion, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
FEW_TERMS = 64


def postings(rows: DataFrame, key: str, text: str, *carry: str) -> DataFrame:
    """key, carry, term, tf, len: one row a term of a row; partial counts stay inside the row, so nothing is shuffled."""
    out = rows.select(key, *carry, T.terms(T.term_key(F.col(text))).alias("_ts"))
    out = out.select(key, *carry, F.size("_ts").cast("long").alias("len"), F.explode(F.array_sort("_ts")).alias("term"))
    return out.groupBy(key, *carry, "len", "term").agg(F.count("*").alias("tf"))


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda t: t == term)).cast("long")


def bm25(rows: DataFrame, key: str, text: str, query: list[str], every: bool = True, *carry: str) -> DataFrame:
    """key, carry, score (smaller is better, rounded to 9) of rows that hold all (or any) of the query's terms.

    Each row counts its own query terms, so only rows with a hit leave the scan; the corpus figures are one
    aggregated row. len and N are over all rows.
    """
    query = list(dict.fromkeys(query))
    tokens = T.terms(T.term_key(F.col(text)))
    df = T.apart(rows.select(key, *carry, tokens.alias("_ts")))
    df = df.select("_m", key, *carry, F.size("_ts").cast("long").alias("_len"), *[_occurrences("_ts", q).alias(f"_f{i}") for i, q in enumerate(query)])
    figures = df.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(query))])
    hits = [F.col(f"_f{i}") > 0 for i in range(len(query))]
    keep = hits[0]
    for h in hits[1:]:
        keep = keep & h if every else keep | h
    df = df.where(keep & (F.col("_m") >= 0)).crossJoin(F.broadcast(figures))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"_f{i}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return df.select(key, *carry, F.round(score, 9).alias("score"))


def top(rows: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k by order (of each group), with rank from 1. Groups are cut by Spark's window group limit before the shuffle."""
    if by:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    cut = rows.orderBy(*order).limit(k)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def exact(rows: DataFrame, key: str, text: str, needle: str, limit: int = 3, before: int = 80, after: int = 120) -> DataFrame:
    """key, hit_count, lines (first distinct ones), context of rows whose normal text holds the normal needle."""
    n = F.lit(T.fold(needle))
    hay = F.regexp_replace(F.replace(F.lower(F.col(text)), F.lit("ß"), F.lit("ss")), "[ \t]+", " ")
    df = T.apart(rows.select(key, hay.alias("_h"))).where(F.contains("_h", n) & (F.col("_m") >= 0)).drop("_m")
    parts = F.split("_h", F.concat(F.lit("\\Q"), n, F.lit("\\E")))
    df = df.withColumn("_parts", parts)
    df = df.withColumn("_breaks", F.transform(F.slice("_parts", F.lit(1), F.size("_parts") - 1), lambda p: (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).cast("long")))
    lines = F.expr("transform(_breaks, (x, i) -> 1L + aggregate(slice(_breaks, 1, i + 1), 0L, (a, b) -> a + b))")
    at = F.locate(T.fold(needle), F.col("_h"))
    return df.select(key, T.hit_count(F.col("_h"), n).alias("hit_count"), F.array_join(F.slice(F.array_distinct(lines), 1, limit), ",").alias("lines"), T.context(F.col("_h"), at, F.length(n), before, after).alias("context"))


def ladder(rows: DataFrame, key: str, text: str, query: str, *groups: str) -> DataFrame:
    """key, groups, step of the first step of the ladder that has a hit in the group.

    1 all terms, 2 content terms, 3 stems as prefixes, 4 any content term. A step that equals an earlier one is left out."""
    folded = [t for t in _tokens(query)]
    content = [t for t in folded if len(t) >= 2 and t not in T.STOP_WORDS]
    stems = [_stem(t) for t in content]
    has = lambda t: F.array_contains("_ts", t)
    begins = lambda s: F.exists("_ts", lambda t: t.startswith(s))
    steps = [(1, _all([has(t) for t in folded]))] if folded else []
    if content and content != folded:
        steps.append((2, _all([has(t) for t in content])))
    if content and stems != content:
        steps.append((3, _all([begins(s) for s in stems])))
    if len(content) >= 2:
        steps.append((4, _any([has(t) for t in content[:8]])))
    step: Column = F.lit(None).cast("long")
    for k, test in reversed(steps):
        step = F.when(test, F.lit(k).cast("long")).otherwise(step)
    df = T.apart(rows.select(key, *groups, T.terms(T.norm(F.col(text))).alias("_ts"))).withColumn("step", step)
    df = df.where("step is not null and _m >= 0").drop("_ts", "_m")
    first = df.groupBy(*groups).agg(F.min("step").alias("_first"))
    return df.join(first, list(groups)).where("step = _first").drop("_first") if groups else df.crossJoin(first).where("step = _first").drop("_first")


def _tokens(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", T.fold(query))))


def _stem(t: str) -> str:
    return next((t[: -len(s)] for s in T.SUFFIXES if t.endswith(s) and len(t) - len(s) >= 3), t)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def metadata_rows(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """key, field, value, norm: array fields flattened to rows, once each."""
    named = lambda n, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(n).alias("field"), v.alias("value")))
    parts = [named(n, c) for n, c in fields.items()]
    df = rows.select(key, F.explode(F.concat(*parts)).alias("x")).select(key, "x.field", "x.value", T.norm(F.col("x.value")).alias("norm"))
    return df.where("norm <> ''").groupBy(key, "field", "norm").agg(F.min("value").alias("value"))


def metadata_hits(meta: DataFrame, key: str, query: str, priority: list[str]) -> DataFrame:
    """key, quality, priority, field: best match of each row. Quality 0 equal, 1 all terms, 2 half of them or more."""
    wanted = _tokens(query)
    have = T.terms(F.col("norm"))
    found = F.size(F.array_intersect(have, F.array(*[F.lit(t) for t in wanted])))
    same = F.array_join(F.array_sort(F.array_distinct(have)), " ") == " ".join(sorted(wanted))
    quality = F.when(same, 0).when(found == len(wanted), 1).when(found >= max(1, -(-len(wanted) // 2)), 2)
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("field")) - 1
    df = T.apart(meta).select(key, "field", "_m", quality.cast("long").alias("quality"), order.cast("long").alias("priority")).where("quality is not null and _m >= 0")
    best = df.groupBy(key).agg(F.min(F.struct("quality", "priority", "field")).alias("m"))
    return best.select(key, "m.quality", "m.priority", "m.field")


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score, n_lists: reciprocal rank fusion of (key, rank) lists."""
    every = lists[0].select(key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(key, "rank"))
    return every.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.count("*").alias("n_lists"))


def fuse_routes(routes: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score, paths, matched: reciprocal rank fusion of routes (key, rank, matched), with the routes and what matched in any, once each."""
    every = None
    for name, rows in routes.items():
        part = rows.select(key, "rank", "matched", F.lit(name).alias("_path"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(key, "_path").agg(F.min("rank").alias("rank"), F.array_distinct(F.flatten(F.collect_list("matched"))).alias("matched"))
    return best.groupBy(key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.array_sort(F.collect_list("_path")).alias("paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched")
    )


def capped(rows: DataFrame, source: str, order: list[Column], most: int = 3) -> DataFrame:
    """Rows in order with at most ``most`` of each source."""
    return rows.withColumn("in_source", F.row_number().over(Window.partitionBy(source).orderBy(*order)).cast("long")).where(F.col("in_source") <= most)


def interleave(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Round robin over the groups' ranks, first occurrence of a key kept, cut at k."""
    first = rows.groupBy(key).agg(F.min(F.struct("rank", group)).alias("m")).select(key, "m.rank", f"m.{group}")
    cut = first.orderBy("rank", group).limit(k)
    return cut.withColumn("position", F.row_number().over(Window.orderBy("rank", group)).cast("long"))


def union_first(strict: DataFrame, relaxed: DataFrame, key: str) -> DataFrame:
    """Rows of two lists (key, rank), the first list winning; position over both."""
    both = strict.select(key, "rank", F.lit(1).alias("list")).unionByName(relaxed.select(key, "rank", F.lit(2).alias("list")))
    best = both.groupBy(key).agg(F.min(F.struct("list", "rank")).alias("m")).select(key, F.col("m.list").cast("long").alias("list"), "m.rank")
    return best


def representative(chunks: DataFrame, hits: DataFrame, artifact: str, chunk: str, order: str) -> DataFrame:
    """artifact, chunk: its best-ranked hit, else its first chunk."""
    best = hits.groupBy(artifact).agg(F.min_by(chunk, "rank").alias("_best"))
    first = chunks.groupBy(artifact).agg(F.min_by(chunk, order).alias("_first"))
    return first.join(best, artifact, "left").select(artifact, F.coalesce("_best", "_first").alias(chunk))


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows behind ``after``; the filter reaches the scan."""
    rows = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def offset_page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows offset+1 .. offset+size in order, with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).limit(offset + size)
    cut = cut.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("position") > offset)
    return cut.crossJoin(F.broadcast(total)).withColumn("more_available", F.col("total") > offset + size)
