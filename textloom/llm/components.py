"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Keys with more rows than this, and than one in MOST_HOT of all rows, are joined by broadcast.
LEAST_HOT = 1000
MOST_HOT = 10_000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with table (one row a key; ``_c``: how many of ``total`` rows have it).

    At most MOST_HOT keys can be hot, so their rows of the table are broadcast and their rows of ``rows`` stay
    where they are; the other keys are shuffled. No key fills a task."""
    least = max(LEAST_HOT, total // MOST_HOT)
    hot, cold = table.where(F.col("_c") > least).drop("_c"), table.where(F.col("_c") <= least).drop("_c")
    here = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("merge"), on, how)
    return here.unionByName(rest)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Every node's neighbours move to the least of them and itself: larger ones, or smaller ones and itself."""
    both = edges.unionAll(edges.selectExpr("v as u", "u as v")) if large else edges.selectExpr("greatest(u, v) as u", "least(u, v) as v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_c"))
    moved = hot_join(both, least, ["u"], total)
    if large:
        out = moved.where("v > u").selectExpr("v as u", "m as v")
    else:
        out = moved.selectExpr("v as u", "m as v").unionAll(least.selectExpr("u", "m as v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of every node of ``edges`` (u, v); null ends are dropped.

    Nothing is collected but a count a round; each round is written to the shared folder. Every round moves links
    to lesser nodes, so the rounds come to an end.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    count = edges.count()
    while count:
        star = saved(_star(edges, True, 2 * count), "edges")
        new = saved(_star(star, False, count), "edges")
        more = new.count()
        same = more == count and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges, count = new, more
        if same:
            break
    return edges.selectExpr("u as node", "v as component").unionAll(edges.selectExpr("v as node", "v as component").distinct())
