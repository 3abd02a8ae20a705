"""Bounded breadth-first expansion of many requests at once, and the route of hits it gives.

The adjacency is cut to what an expansion can open (the first ``fan_out`` edges of a node, with its degree), so a hub brings no more rows than
any node. Each step joins the frontier of all requests with it, and windows by request, whose rows are bounded by its nodes times the
fan-out, decide which nodes are new, which fit, and which further ways are kept. Steps are written and read again, so
lineage stays short and a lost executor costs one step. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_path
from .graph import both_ways


@dataclass(frozen=True)
class Bounds:
    """Bounds of an expansion."""

    seeds: int = 8
    depth: int = 2
    nodes: int = 40
    fan_out: int = 10
    hub: int = 24
    other_ways: int = 3


STEP = "struct<src:string,dst:string,kind:string,dir:string>"


def adjacency(e: DataFrame, fan_out: int = Bounds.fan_out) -> DataFrame:
    """node, place, degree, other, kind, dir: the first edges of each node by (kind, other, direction).

    Spark cuts each node's edges before the shuffle (window group limit); degrees are partial counts."""
    b = both_ways(e).select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind", "dir")
    first = b.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("kind", "other", "dir"))).where(F.col("place") <= fan_out)
    return first.join(b.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(by: list[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")


def expand(e: DataFrame, seeds: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """request, node, depth, place, seed, via (steps from the seed), also_via (other ways to it), leaf, capped, truncated.

    seeds: request, place, node; of each request the first ``bounds.seeds`` distinct nodes by (place, node) count. Places number a request's nodes in order of
    visit. A node of more than ``bounds.hub`` edges that is no seed is a leaf; of more than ``bounds.fan_out``, capped (its first edges are opened). ``truncated``: the request met
    nodes beyond ``bounds.nodes``. Other ways are those by another last node, in order of visit, at most ``bounds.other_ways``; seeds have none.
    Null nodes and requests are left out; a seed without edges stays alone; repeated edges count as edges of their own."""
    adj = _kept(adjacency(e.where("src is not null and dst is not null"), bounds.fan_out), "adjacency")
    first = seeds.where("request is not null and node is not null").groupBy("request", "node").agg(F.min("place").alias("p"))
    first = first.withColumn("place", _numbered(["request"], "p", "node")).where(F.col("place") <= min(bounds.seeds, bounds.nodes))
    none = F.array().cast(f"array<{STEP}>")
    seen = _kept(first.select("request", "node", F.lit(0).cast("long").alias("depth"), "place", F.col("node").alias("seed"), none.alias("via"), F.lit(False).alias("cut")), "visited")
    steps = None
    for d in range(1, bounds.depth + 1):
        frontier = seen.where(F.col("depth") == d - 1)
        opened = frontier.join(adj.withColumnRenamed("place", "edge"), "node").where((F.col("degree") <= bounds.hub) | (F.col("depth") == 0))
        step = F.struct(F.col("node").alias("src"), F.col("other").alias("dst"), "kind", "dir")
        walk = opened.select("request", F.col("place").alias("from_place"), "edge", F.col("node").alias("last"), F.col("other").alias("node"), "seed", F.concat("via", F.array(step)).alias("via"), F.lit(d).cast("long").alias("depth"))
        walk = _kept(walk, "steps")
        fresh = walk.join(seen.select("request", "node"), ["request", "node"], "left_anti").withColumn("_k", _numbered(["request", "node"], "from_place", "edge")).where("_k = 1")
        held = seen.groupBy("request").agg(F.count(F.lit(1)).alias("held"))
        fresh = fresh.join(held, "request").withColumn("place", F.col("held") + _numbered(["request"], "from_place", "edge"))
        over = fresh.where(F.col("place") > bounds.nodes).select("request").distinct()
        new = fresh.where(F.col("place") <= bounds.nodes).select("request", "node", "depth", "place", "seed", "via")
        full = seen.select("request", "node", "depth", "place", "seed", "via", "cut").unionByName(new.withColumn("cut", F.lit(False)))
        full = full.join(over.withColumn("_over", F.lit(True)), "request", "left").withColumn("cut", F.col("cut") | F.coalesce("_over", F.lit(False))).drop("_over")
        seen = _kept(full, "visited")
        steps = walk if steps is None else steps.unionByName(walk)
    ways = steps.select("request", "node", "last", F.col("via").alias("way"), "depth", "from_place", "edge") if steps is not None else None
    out = seen
    if ways is not None:
        reached = seen.where("depth > 0").select("request", "node", F.element_at("via", -1)["src"].alias("by"))
        others = ways.join(reached, ["request", "node"]).where("last <> by").withColumn("_k", _numbered(["request", "node"], "depth", "from_place", "edge")).where(F.col("_k") <= bounds.other_ways)
        others = others.groupBy("request", "node").agg(F.array_sort(F.collect_list(F.struct("_k", "way"))).alias("w")).select("request", "node", F.col("w.way").alias("also_via"))
        out = out.join(others, ["request", "node"], "left")
    else:
        out = out.withColumn("also_via", F.lit(None).cast(f"array<array<{STEP}>>"))
    out = out.join(adj.groupBy("node").agg(F.max("degree").alias("degree")), "node", "left")
    opened = F.col("depth") < bounds.depth
    leaf = opened & (F.col("depth") > 0) & (F.coalesce("degree", F.lit(0)) > bounds.hub)
    return out.select(
        "request", "node", "depth", "place", "seed", "via", F.coalesce("also_via", F.array().cast(f"array<array<{STEP}>>")).alias("also_via"), leaf.alias("leaf"),
        (opened & ~leaf & (F.coalesce("degree", F.lit(0)) > bounds.fan_out)).alias("capped"), F.col("cut").alias("truncated"),
    )


def route_hits(visits: DataFrame, holders: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """request, group, rank, node, part, seed, via, matched: the parts that an expansion leads to.

    holders: node, group, part (its representative). evidence: src, dst, kind, part: the part of ``dst`` that states the edge; the least one of the last
    step wins over the representative. Seeds and nodes without a holder are no hits; ranks count by request and group in order of visit.
    matched: kind and direction of each step."""
    hits = visits.where("depth > 0").join(holders.select("node", "group", F.col("part").alias("_rep")), "node")
    if evidence is not None:
        last = F.element_at("via", -1)
        stated = evidence.groupBy("src", "dst", "kind").agg(F.min("part").alias("_said"))
        hits = hits.withColumns({"_s": F.when(last["dir"] == "out", last["src"]).otherwise(last["dst"]), "_d": F.when(last["dir"] == "out", last["dst"]).otherwise(last["src"]), "_k": last["kind"]})
        hits = hits.join(stated, (F.col("_s") == F.col("src")) & (F.col("_d") == F.col("dst")) & (F.col("_k") == F.col("kind")) & (F.col("_s") == F.col("node")), "left").drop("src", "dst", "kind", "_s", "_d", "_k")
        part = F.coalesce("_said", "_rep")
    else:
        part = F.col("_rep")
    hits = hits.withColumn("part", part).withColumn("rank", _numbered(["request", "group"], "place"))
    names = F.concat(F.array("seed"), F.transform(F.slice("via", 1, F.greatest(F.size("via") - 1, F.lit(0))), lambda s: s["dst"]))
    return hits.select("request", "group", "rank", "node", "part", "seed", names.alias("via"), F.transform("via", lambda s: F.concat_ws(":", s["kind"], s["dir"])).alias("matched"))
