"""Expansions of many requests against a walk of each."""

import random
from collections import deque

from pyspark.sql import functions as F

from textloom.operators import graph_route as R


def walk(edges, seeds, b):
    """Visit order of one request: {node: (depth, place, seed, via, also)}, leaves, capped nodes, truncated."""
    near = {}
    for s, d, k in edges:
        near.setdefault(s, []).append((k, d, "out"))
        near.setdefault(d, []).append((k, s, "in"))
    seen, leaves, capped, over = {}, set(), set(), False
    for s in seeds[: min(b.seeds, b.nodes)]:
        seen[s] = (0, len(seen) + 1, s, (), [])
    queue = deque(seen)
    while queue:
        node = queue.popleft()
        depth, _, seed, via, _ = seen[node]
        if depth == b.depth:
            continue
        open_ = sorted(near.get(node, []))
        if len(open_) > b.hub and depth:
            leaves.add(node)
            continue
        if len(open_) > b.fan_out:
            capped.add(node)
        for k, other, way in open_[: b.fan_out]:
            path = (*via, (node, other, k, way))
            if other in seen:
                if seen[other][0] and seen[other][3][-1][0] != node and len(seen[other][4]) < b.other_ways:
                    seen[other][4].append(path)
            elif len(seen) < b.nodes:
                seen[other] = (depth + 1, len(seen) + 1, seed, path, [])
                queue.append(other)
            else:
                over = True
    return seen, leaves, capped, over


def check(spark, edges, seeds, b):
    e = spark.createDataFrame(edges, "src string, dst string, kind string")
    rows = [(r, p, n) for r, own in seeds.items() for p, n in enumerate(own)]
    got = {}
    for r in R.expand(e, spark.createDataFrame(rows, "request long, place long, node string"), b).collect():
        got.setdefault(r.request, {})[r.node] = r
    assert set(got) == set(seeds)
    for request, own in seeds.items():
        seen, leaves, capped, over = walk(edges, list(dict.fromkeys(own)), b)
        assert set(got[request]) == set(seen)
        for node, (depth, place, seed, via, also) in seen.items():
            r = got[request][node]
            assert (r.depth, r.place, r.seed, tuple(map(tuple, r.via))) == (depth, place, seed, via)
            assert [tuple(map(tuple, w)) for w in r.also_via] == also
            assert (r.leaf, r.capped, r.truncated) == (node in leaves, node in capped, over)


def test_random_graphs(spark):
    r = random.Random(8)
    for n, m, b in ((12, 30, R.Bounds()), (60, 260, R.Bounds(nodes=15, fan_out=4, hub=7, other_ways=2)), (40, 90, R.Bounds(depth=3, seeds=2, nodes=20))):
        name = [f"n{i}" for i in range(n)]
        edges = [(r.choice(name), name[int(n * r.random() ** 3)], r.choice("ab")) for _ in range(m)]
        edges += edges[:3] + [(name[0], name[0], "a")]
        check(spark, edges, {k: [r.choice(name) for _ in range(r.randint(1, 11))] for k in range(6)} | {99: ["nowhere"]}, b)


def test_empty_and_null(spark):
    e = spark.createDataFrame([("a", "b", "k"), (None, "b", "k"), ("a", None, "k")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([(1, 1, "a"), (None, 1, "a"), (2, 1, None)], "request long, place long, node string")
    assert {(r.request, r.node) for r in R.expand(e, seeds).collect()} == {(1, "a"), (1, "b")}
    assert R.expand(e, seeds.limit(0)).count() == 0
    assert {r.node for r in R.expand(e.limit(0), seeds).collect()} == {"a"}


def test_hits_prefer_the_part_that_states_the_edge(spark):
    e = spark.createDataFrame([("a", "x", "k"), ("b", "x", "k"), ("x", "c", "k")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([(1, 1, "x")], "request long, place long, node string")
    holders = spark.createDataFrame([("a", "g", "a0"), ("b", "g", "b0"), ("c", "h", "c0"), ("x", "g", "x0")], "node string, group string, part string")
    stated = spark.createDataFrame([("a", "x", "k", "a7"), ("a", "x", "k", "a5"), ("x", "c", "k", "x9")], "src string, dst string, kind string, part string")
    got = {(r.group, r["rank"]): (r.node, r.part, list(r.via), list(r.matched)) for r in R.route_hits(R.expand(e, seeds), holders, stated).collect()}
    assert got == {("g", 1): ("a", "a5", ["x"], ["k:in"]), ("g", 2): ("b", "b0", ["x"], ["k:in"]), ("h", 1): ("c", "c0", ["x"], ["k:out"])}
    assert R.route_hits(R.expand(e, seeds), holders).where(F.col("part") == "a0").count() == 1
