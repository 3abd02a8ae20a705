"""Property graph: edges, resolution of targets, neighbours, bounded expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of an expansion.
SEEDS, DEPTH, NODES, FAN_OUT, HUB_DEGREE = 8, 2, 40, 10, 24


def edges(*parts: tuple[DataFrame, Column, Column, str]) -> DataFrame:
    """src, dst, kind of (rows, source, target, kind) parts."""
    out = None
    for rows, src, dst, kind in parts:
        part = rows.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("kind")).where("src is not null and dst is not null")
        out = part if out is None else out.unionByName(part)
    return out


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "kind", F.lit("out").alias("dir")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", F.lit("in").alias("dir")))


def neighbors(e: DataFrame, nodes: list[str]) -> DataFrame:
    """node, other, kind, dir of the given nodes, both directions, once each; the filter reaches both scans."""
    b = both_ways(e).where(F.col("src").isin(nodes))
    return b.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind", "dir").distinct()


def canonical(e: DataFrame, aliases: DataFrame) -> DataFrame:
    """src, dst, kind with every endpoint that is another name of a node replaced by that node; edges that then begin where they end go, equal ones are one.

    aliases: ref, node (the least of a ref's nodes counts). Both joins meet on the name, so a popular name is spread like any skewed join."""
    named = aliases.groupBy("ref").agg(F.min("node").alias("node"))
    out = e.join(named.select(F.col("ref").alias("src"), F.col("node").alias("_src")), "src", "left").join(named.select(F.col("ref").alias("dst"), F.col("node").alias("_dst")), "dst", "left")
    out = out.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "kind")
    return out.where("src <> dst").distinct()


def owners(refs: DataFrame, holders: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with owner: the holder of that very name, else the least holder one of whose layers bears it, else null.

    holders: node, ref, layers (array of names); layers are exploded and met by name, never searched one by one."""
    own = holders.groupBy(F.col("ref").alias("_r")).agg(F.min("node").alias("_own"))
    layer = holders.select("node", F.explode("layers").alias("_l")).groupBy("_l").agg(F.min("node").alias("_layer"))
    j = refs.join(own, F.col(ref) == F.col("_r"), "left").join(layer, F.col(ref) == F.col("_l"), "left")
    return j.withColumn("owner", F.coalesce("_own", "_layer")).drop("_r", "_own", "_l", "_layer")


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def k_hop(e: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, depth: least number of undirected steps from a seed, up to ``hops``. Each step is one join of the frontier."""
    pairs = both_ways(e).select("src", "dst").distinct()
    reached = seeds.select(F.col("node"), F.lit(0).cast("long").alias("depth")).distinct()
    for d in range(1, hops + 1):
        step = reached.where(F.col("depth") == d - 1).join(pairs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(d).cast("long").alias("depth")).distinct()
        reached = reached.unionByName(step.join(reached.select("node"), "node", "left_anti"))
    return reached


def expand(e: DataFrame, seeds: list[str], depth: int = DEPTH, most: int = NODES, fan_out: int = FAN_OUT, hub: int = HUB_DEGREE) -> DataFrame:
    """node, depth, seed, via: bounded breadth-first expansion of a few seeds.

    Each node opens its first ``fan_out`` edges in (kind, other, dir) order; a node over ``hub`` degrees that is no
    seed is not opened; at most ``most`` nodes. Only the frontier's own edges (bounded) reach the driver."""
    spark = e.sparkSession
    seeds = list(dict.fromkeys(seeds))[:SEEDS]
    found = {s: (0, s, None) for s in seeds}
    frontier = list(seeds)
    for d in range(1, depth + 1):
        if not frontier or len(found) >= most:
            break
        near = both_ways(e).where(F.col("src").isin(frontier))
        w = Window.partitionBy("src").orderBy("kind", "dst", "dir")
        near = near.withColumn("degree", F.count("*").over(Window.partitionBy("src"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= fan_out)
        rows: dict[str, list] = {}
        for r in near.collect():  # at most fan_out rows a frontier node
            rows.setdefault(r["src"], []).append(r)
        nxt = []
        for node in frontier:
            own = sorted(rows.get(node, []), key=lambda r: r["r"])
            if own and own[0]["degree"] > hub and node not in seeds:
                continue
            for r in own:
                if r["dst"] not in found and len(found) < most:
                    found[r["dst"]] = (d, found[node][1], node)
                    nxt.append(r["dst"])
        frontier = nxt
    return spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in found.items()], "node string, depth long, seed string, via string")


def resolve(targets: DataFrame, column: str, names: DataFrame, *keys: str) -> DataFrame:
    """Adds resolved_id: the id of the first of the key columns in which the target is unique."""
    out, tried = targets, []
    for k in keys:
        one = names.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k_{k}")).agg(F.min("id").alias(f"_r_{k}"), F.count_distinct("id").alias("_n")).where("_n = 1").drop("_n")
        out = out.join(one, F.col(column) == F.col(f"_k_{k}"), "left").drop(f"_k_{k}")
        tried.append(f"_r_{k}")
    return out.withColumn("resolved_id", F.coalesce(*tried)).drop(*tried)


def dangling(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return e.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def orphans(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes that no edge enters; the many edges into a node are one row before they meet it."""
    return nodes.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def hrefs(rows: DataFrame, key: str, html: str) -> DataFrame:
    """key, target: link targets of HTML."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*href="([^"#]*)'), 1)
    return rows.select(key, F.explode(found).alias("target"))
