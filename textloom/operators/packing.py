"""Ordered folds over ranked lists, for many requests in one plan: two-level fusion, shares of direct hits, token budgets.

A running cost never needs a list in one task: rows are range-partitioned by (request, order) and written with their partition, each
partition sums its requests, the few sums are added up, and each partition then runs on from its offset. So one
request may hold any share of all rows. Costs are at least 0 and a null cost counts as 0; orders should be total (ties fall by chance of sorting).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import shared_path

# Fusion constant and weights, rows of one source, least share of direct hits, tokens a hit costs besides its text, least tokens of a cut hit.
RRF, DIRECT_WEIGHT, GRAPH_WEIGHT = 60, 1.0, 1.0
PER_SOURCE, DIRECT_SHARE = 3, 0.5
OVERHEAD, LEAST_PART = 30, 80
_FILLER = "￿"


def running(rows: DataFrame, by: list[str], order: list[Column], cost: str, below: int | None = None) -> DataFrame:
    """rows with ``before``: the cost of the rows of the same ``by`` that come earlier in order. ``below`` leaves out rows with that much or more before them."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "ordered")
    rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    df = spark.read.parquet(path)
    own = F.coalesce(F.col(cost).cast("long"), F.lit(0))
    sums = df.groupBy("_part", *by).agg(F.sum(own).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    if below is not None:
        sums = sums.where(F.col("_ahead") < below)
    same = df["_part"] == sums["_part"]
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(sums[f"_by{i}"])
    df = df.join(sums, same).drop(sums["_part"])
    local = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", (F.col("_ahead") + F.coalesce(F.sum(own).over(local), F.lit(0))).cast("long"))
    return (df if below is None else df.where(F.col("before") < below)).select(*rows.columns, "before")


def prefix(rows: DataFrame, by: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each ``by``'s rows whose running cost fits the budget, with ``running``: the cost up to and with a row."""
    kept = running(rows, by, order, cost, budget + 1).withColumn("running", F.col("before") + F.coalesce(F.col(cost).cast("long"), F.lit(0)))
    return kept.where(F.col("running") <= budget).drop("before")


def order(candidates: DataFrame, direct: list[str], graph: str = "r_graph", k: int = RRF) -> DataFrame:
    """candidates (request, group, key, source, ranks by route) with score, is_direct, place: fused on two levels, at most PER_SOURCE of a source.

    Direct routes are fused by reciprocal ranks into one ranking, which is then fused with the graph's; ties go to direct hits, their rank, the key. Candidates without any rank are left out."""
    ranks = [F.col(c) for c in direct]
    is_direct = F.greatest(*[c.isNotNull() for c in ranks]) if len(ranks) > 1 else ranks[0].isNotNull()
    best = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    inner = sum((F.coalesce(1.0 / (k + c), F.lit(0.0)) for c in ranks), F.lit(0.0))
    own = Window.partitionBy("request", "group")
    df = candidates.where(is_direct | F.col(graph).isNotNull()).select("*", is_direct.alias("is_direct"), F.round(inner, 12).alias("_inner"), best.alias("_best"))
    df = df.withColumn("_d", F.when(F.col("is_direct"), F.row_number().over(own.orderBy(F.desc("is_direct"), F.desc("_inner"), "_best", "key"))))
    df = df.withColumn("_g", F.when(F.col(graph).isNotNull(), F.row_number().over(own.orderBy(F.col(graph).asc_nulls_last(), "key"))))
    score = F.coalesce(DIRECT_WEIGHT / (k + F.col("_d")), F.lit(0.0)) + F.coalesce(GRAPH_WEIGHT / (k + F.col("_g")), F.lit(0.0))
    df = df.withColumn("score", F.round(score, 12))
    ranking = [F.desc("score"), F.desc("is_direct"), F.col("_d").asc_nulls_last(), F.col("key")]
    df = df.withColumn("_s", F.row_number().over(Window.partitionBy("request", "group", "source").orderBy(*ranking))).where(F.col("_s") <= PER_SOURCE)
    return df.withColumn("place", F.row_number().over(own.orderBy(*ranking)).cast("long")).drop("_inner", "_best", "_d", "_g", "_s")


def reserve(rows: DataFrame, by: list[str], place: str, direct: str, width: int, share: float = DIRECT_SHARE) -> DataFrame:
    """rows with ``position``: each window of ``width`` holds its share of direct rows while there are any; all else stays in order.

    Only the order of direct and of other rows matters: a window takes d direct and width - d other rows from the heads of both, d being
    those among its first ``width`` rows or the share, whichever is more. An array aggregate per ``by`` carries how many of either are gone and the row
    numbers so far; a list is one row, so its length should be bounded (as ranked pools are)."""
    need = math.ceil(share * width)
    at = F.struct(F.col(place).alias("p"), F.col(direct).alias("d"))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(at)).alias("_all"))
    lists = lists.select(*by, F.expr("transform(filter(_all, x -> coalesce(x.d, false)), x -> x.p)").alias("_d"), F.expr("transform(filter(_all, x -> not coalesce(x.d, false)), x -> x.p)").alias("_o"))
    step = f"""aggregate(
        sequence(1, cast(ceil((size(_d) + size(_o)) / {width}) as int)),
        named_struct('i', 0, 'j', 0, 'out', slice(concat(_d, _o), 1, 0)),
        (s, w) -> transform(array(named_struct('i', s.i, 'j', s.j, 'out', s.out, 'dd', slice(_d, s.i + 1, {width}), 'oo', slice(_o, s.j + 1, {width}))), t ->
          transform(array(least(size(t.dd), greatest({need}, {width} - size(t.oo), size(filter(transform(t.dd, (x, k) -> k + size(filter(t.oo, y -> y < x))), c -> c < {width}))))), d ->
            named_struct('i', t.i + d, 'j', t.j + least(size(t.oo), {width} - d), 'out', concat(t.out, array_sort(concat(slice(t.dd, 1, d), slice(t.oo, 1, {width} - d))))))[0])[0],
        s -> s.out)"""
    placed = lists.select(*by, F.posexplode(F.expr(step)).alias("_k", place))
    return rows.join(placed, [*by, place]).withColumn("position", (F.col("_k") + 1).cast("long")).drop("_k")


def cut_to(text: Column, tokens: Column) -> Column:
    """The longest prefix of an estimate of at most ``tokens``, back to its last white space if that keeps four fifths of it.

    A character outside ASCII weighs as two: with a filler before each, a prefix of 4 x tokens characters is what fits."""
    room = (tokens * 4).cast("int")
    spread = F.regexp_replace(F.substring(text, F.lit(1), room), r"([^\x00-\x7F])", _FILLER + "$1")
    whole = F.replace(F.substring(spread, F.lit(1), room), F.lit(_FILLER), F.lit(""))
    last = F.locate(" ", F.reverse(F.translate(whole, "\n", " ")))
    to = F.length(whole) - last
    return F.when((F.length(whole) < F.length(text)) & (last > 0) & (to > 0.8 * F.length(whole)), F.substring(whole, F.lit(1), to)).otherwise(whole)


def pack(rows: DataFrame, budget: int, limit: int) -> DataFrame:
    """rows (request, group_place, place, text, ...) that a budget of tokens pays for, with turn, content, truncated, tokens, left.

    Groups take turns in the order of group_place, each by place, at most ``limit`` rows a group. A row costs OVERHEAD and its text's estimate; the first row that does not fit ends its request: it
    is cut to a prefix that fits if it is the request's first or LEAST_PART tokens are left for it. A null text is empty. place counts from 1 in each group."""
    df = rows.where(F.col("place") <= limit).withColumn("_t", F.coalesce("text", F.lit("")))
    df = df.withColumns({"_cost": T.estimate_tokens(F.col("_t")) + OVERHEAD})
    df = running(df, ["request"], [F.col("place"), F.col("group_place")], "_cost", budget + 1)
    df = df.withColumns({"_left": budget - F.col("before"), "_fits": (F.col("_cost") <= budget - F.col("before")) & (budget - F.col("before") > OVERHEAD)})
    stop = df.where(~F.col("_fits")).groupBy("request").agg(F.min(F.struct("place", "group_place")).alias("_stop"))
    df = df.join(stop, "request", "left").withColumn("_at", F.struct("place", "group_place"))
    df = df.where(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    whole = F.col("_fits")
    partial = ~whole & ((F.col("before") == 0) | (F.col("_left") >= LEAST_PART + OVERHEAD))
    df = df.where(whole | partial).withColumn("content", F.when(whole, F.col("_t")).otherwise(cut_to(F.col("_t"), F.greatest(F.col("_left") - OVERHEAD, F.lit(1)))))
    df = df.where(whole | (F.length("content") > 0)).withColumn("tokens", T.estimate_tokens(F.col("content")) + OVERHEAD)
    turn = F.row_number().over(Window.partitionBy("request").orderBy("place", "group_place")).cast("long")  # as many rows as the budget holds
    return df.select(*rows.columns, turn.alias("turn"), "content", (~whole).alias("truncated"), "tokens", (F.col("_left") - F.col("tokens")).alias("left"))


def answer(candidates: DataFrame, texts: DataFrame, direct: list[str], budget: int, limit: int, width: int | None = None) -> DataFrame:
    """request, group, key, position, score, is_direct, turn, content, truncated, tokens, left, more: whole answers of many requests.

    candidates (request, group, key, source, ranks by route, r_graph) are fused, capped by source and given their share of direct hits in windows of
    ``width`` (``limit`` without one); groups then take turns by name within the budget. Texts (key, text) are joined for rows that can be shown alone. ``more``: the group has candidates behind those shown."""
    placed = reserve(order(candidates, direct), ["request", "group"], "place", "is_direct", width or limit)
    names = placed.select("request", "group").distinct().withColumn("group_place", F.row_number().over(Window.partitionBy("request").orderBy("group")).cast("long"))
    sizes = placed.groupBy("request", "group").agg(F.count(F.lit(1)).alias("_all"))
    rows = placed.where(F.col("position") <= limit).join(names, ["request", "group"]).join(texts.select("key", "text"), "key")
    shown = pack(rows.select("request", "group_place", F.col("position").alias("place"), "text", "group", "key", "score", "is_direct"), budget, limit)
    out = shown.join(sizes, ["request", "group"]).withColumn("_shown", F.max("place").over(Window.partitionBy("request", "group")))
    return out.select("request", "group", "key", F.col("place").alias("position"), "score", "is_direct", "turn", "content", "truncated", "tokens", "left", (F.col("_all") > F.col("_shown")).alias("more"))
