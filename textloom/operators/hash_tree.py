"""A manifest as a tree of digests: one root for any number of rows, without a task that sees them all.

Leaves are digests of (path, digest), numbered in the order of their paths by a running count over range partitions;
``WIDTH`` neighbours make a node, nodes of a level the next one, up to a single root. A group of a level is WIDTH rows, whatever the data. Two
manifests are compared from the top: only nodes that differ are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import shared_path
from .packing import running

WIDTH = 256


def tree(rows: DataFrame, path: str, digest: str, width: int = WIDTH) -> DataFrame:
    """level (0: leaves), node, path (of leaves; the first below a node else), hash: every node, written.

    Paths should be unique and not null (null ones are left out); a null digest counts as an empty one. No rows give no nodes."""
    spark, out = rows.sparkSession, shared_path(rows.sparkSession, "tree")
    leaves = rows.where(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(digest), F.lit("")).alias("d"), F.lit(1).alias("one"))
    level = running(leaves, [], [F.col("path")], "one").select(F.col("before").alias("node"), "path", F.sha2(F.concat_ws(":", "path", "d"), 256).alias("hash"))
    level.write.parquet(f"{out}/level=0")
    n, depth = spark.read.parquet(f"{out}/level=0").count(), 0
    while n > 1:
        below = spark.read.parquet(f"{out}/level={depth}")
        parts = below.groupBy(F.floor(F.col("node") / width).cast("long").alias("node")).agg(F.min("path").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "").alias("h"))
        depth, n = depth + 1, -(-n // width)
        parts.select("node", "path", F.sha2("h", 256).alias("hash")).write.parquet(f"{out}/level={depth}")
    return spark.read.parquet(out).select("level", "node", "path", "hash")


def root(nodes: DataFrame) -> DataFrame:
    """hash, leaves, levels of a tree in one row; nulls for an empty one."""
    return nodes.agg(F.max_by("hash", "level").alias("hash"), F.count_if(F.col("level") == 0).alias("leaves"), F.max("level").cast("long").alias("levels"))


def differing(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """path, change (added, removed, changed) of the leaves of two trees of one width.

    If as many leaves stand in both, nodes are compared level by level from the top and equal ones are not opened, as long as their first paths agree;
    after insertions places shift, and the leaves below unlike nodes meet by path."""
    top = max(x.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] for x in (a, b))
    open_ = None
    for level in range(top, 0, -1):
        x = a.where(F.col("level") == level).select("node", F.col("hash").alias("h"))
        y = b.where(F.col("level") == level).select("node", F.col("hash").alias("g"))
        unlike = x.join(y, "node", "full_outer").where(~F.col("h").eqNullSafe(F.col("g"))).select("node")
        if open_ is not None:
            unlike = unlike.join(open_, F.floor(unlike["node"] / width) == open_["up"], "left_semi")
        open_ = unlike.select(F.col("node").alias("up"))
    x, y = a.where("level = 0"), b.where("level = 0")
    if open_ is not None:
        x, y = (z.join(open_, F.floor(z["node"] / width) == open_["up"], "left_semi") for z in (x, y))
    j = x.select("path", F.col("hash").alias("h")).join(y.select("path", F.col("hash").alias("g")), "path", "full_outer").where(~F.col("h").eqNullSafe(F.col("g")))
    return j.select("path", F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").otherwise("changed").alias("change"))
