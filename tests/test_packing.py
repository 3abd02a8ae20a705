"""Folds over ranked lists against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import packing as P


def test_running_cost_over_partitions(spark):
    r = random.Random(1)
    rows = [(q, i, r.choice([0, 1, 5, None])) for q in ("hot", "x", None) for i in range(2000 if q == "hot" else 30)]
    df = spark.createDataFrame(rows, "q string, i long, c long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.q, x.i): x.before for x in P.running(df, ["q"], [F.desc("i")], "c").collect()}
        few = {(x.q, x.i): x.running for x in P.prefix(df, ["q"], [F.desc("i")], "c", 40).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, short = {}, {}
    for q in ("hot", "x", None):
        total = 0
        for _, i, c in sorted((x for x in rows if x[0] == q), key=lambda x: -x[1]):
            want[q, i] = total
            total += c or 0
            if total <= 40:
                short[q, i] = total
    assert got == want and few == short
    assert P.running(df.limit(0), ["q"], [F.col("i")], "c").count() == 0


def reserved(flags, width, share):
    """Places of a list of direct flags, window after window."""
    need, left, out = math.ceil(share * width), list(range(len(flags))), []
    while left:
        win, rest = left[:width], left[width:]
        spare = [x for x in rest if flags[x]][: max(0, need - sum(flags[x] for x in win))]
        lost = [x for x in reversed(win) if not flags[x]][: len(spare)]
        win = sorted([x for x in win if x not in lost] + spare)
        out += win
        left = [x for x in left if x not in win]
    return out


@pytest.mark.parametrize(("width", "share"), [(4, 0.5), (10, 0.5), (3, 1.0), (5, 0.0), (1, 0.5)])
def test_shares_of_direct_rows(spark, width, share):
    r = random.Random(width)
    lists = {q: [r.random() < r.choice([0.1, 0.5, 0.9]) for _ in range(r.randint(0, 40))] for q in range(40)}
    rows = [(q, 10 * i, f, "x") for q, flags in lists.items() for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "q long, place long, direct boolean, `a.b` string").repartition(3)
    got = {}
    for x in P.reserve(df, ["q"], "place", "direct", width, share).collect():
        got.setdefault(x.q, {})[x.position] = x.place // 10
    for q, flags in lists.items():
        assert [v for _, v in sorted(got.get(q, {}).items())] == reserved(flags, width, share)


def estimate(t):
    return math.ceil(sum(1 if ord(c) < 128 else 2 for c in t) / 4)


def longest(text, tokens):
    n = max(k for k in range(len(text) + 1) if estimate(text[:k]) <= tokens and k <= 4 * tokens and len(text[:k].encode()) <= 12 * tokens)
    cut = text[:n]
    space = max(cut.rfind(" "), cut.rfind("\n"))
    return cut[:space] if n < len(text) and space > 0.8 * n else cut


def packed(groups, budget, limit):
    """[(group, place, content, truncated)] by turns."""
    out, left, place = [], budget, 0
    while any(place < min(limit, len(g)) for g in groups):
        for k, g in enumerate(groups):
            if place >= min(limit, len(g)):
                continue
            text = g[place] or ""
            room = left - P.OVERHEAD
            if room > 0 and estimate(text) <= room:
                out.append((k, place + 1, text, False))
                left -= estimate(text) + P.OVERHEAD
                continue
            if not out or left >= P.LEAST_PART + P.OVERHEAD:
                cut = longest(text, max(room, 1))
                if cut:
                    out.append((k, place + 1, cut, True))
            return out
        place += 1
    return out


def test_budgets_of_tokens(spark):
    r = random.Random(6)
    say = lambda n: "".join(r.choice("ab é\n😀 c") for _ in range(n))
    for budget, limit in ((300, 5), (60, 9), (25, 3), (4000, 4), (141, 50)):
        asked = {q: [[None if r.random() < 0.05 else say(r.choice([0, 5, 90, 700])) for _ in range(r.randint(0, 8))] for _ in range(r.randint(1, 3))] for q in range(25)}
        rows = [(q, k, i + 1, t, "kept") for q, gs in asked.items() for k, g in enumerate(gs) for i, t in enumerate(g)]
        df = spark.createDataFrame(rows, "request long, group_place long, place long, text string, key string").repartition(3)
        got = {}
        for x in sorted(P.pack(df, budget, limit).collect(), key=lambda x: x.turn):
            got.setdefault(x.request, []).append((x.group_place, x.place, x.content, x.truncated))
            assert x.tokens == estimate(x.content) + P.OVERHEAD and x.turn == len(got[x.request])
        for q, gs in asked.items():
            assert got.get(q, []) == packed(gs, budget, limit), (budget, limit, q)


def test_two_levels_of_fusion(spark):
    rows = [(1, "g", "a", "s1", 1, None, None), (1, "g", "b", "s1", 2, 1, 3), (1, "g", "c", "s1", None, None, 1), (1, "g", "d", "s1", 9, 9, None), (1, "g", "e", "s2", None, None, 2), (1, "g", "f", "s2", None, None, None), (2, "g", "a", "s1", None, 4, None)]
    df = spark.createDataFrame(rows, "request long, group string, key string, source string, r_text long, r_meta long, r_graph long")
    got = {}
    for x in P.order(df, ["r_text", "r_meta"]).orderBy("place").collect():
        got.setdefault(x.request, []).append(x.key)
    # direct: b, then d (two routes), then a; by the graph: c, e, b; a is the fourth of s1
    assert got == {1: ["b", "c", "d", "e"], 2: ["a"]}
    scores = {x.key: x.score for x in P.order(df, ["r_text", "r_meta"]).where("request = 1").collect()}
    assert scores["b"] == pytest.approx(1 / 61 + 1 / 63) and scores["c"] == pytest.approx(1 / 61) and scores["d"] == scores["e"] == pytest.approx(1 / 62)
