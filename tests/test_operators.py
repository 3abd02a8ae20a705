import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators import chunking as C
from textloom.operators import evidence as E
from textloom.operators import graph as G
from textloom.operators import packing as P
from textloom.operators import search as S
from textloom.operators import versioning as V
from textloom.streaming import incremental


def make_text(seed: int) -> str:
    r = random.Random(seed)
    parts = []
    for _ in range(r.randint(1, 40)):
        k = r.randint(0, 4)
        parts.append(["# Head %d" % r.randint(0, 9), "word " * r.randint(1, 300), "| a | b |\n| - | - |\n| 1 | 2 |", "Sentence here. " * r.randint(1, 600), "x" * r.randint(1, 9000)][k])
    return r.choice(["", "---\nid: a\n---\n"]) + r.choice(["\n\n", "\n", "\r\n\r\n"]).join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_chunks_partition(seed):
    text = make_text(seed)
    spans = C.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(0 < b - a <= C.HARD for a, b in spans)
    assert not any(text[a - 1 : a + 1] == "\r\n" for a, _ in spans[1:])
    assert spans == C.spans(text)
    if len(text) <= C.SOFT:
        assert len(spans) == 1


def test_heading_path():
    text = "# A\n\nx\n\n## B\n\ny\n\n# C\n\nz"
    assert C.heading_paths(text, [0, text.index("y"), text.index("z")]) == [["A"], ["A", "B"], ["C"]]
    assert C.heading_paths("plain", [0]) == [[]] and C.heading_paths("####### seven\n#nospace", [0, 3]) == [[], []]


def test_block_starts():
    """Headings, text behind blank lines, tables with lead space, front matter with CR LF; nothing else."""
    at = lambda text: [text[a : a + 3] for a in C.block_starts(text)[1:]]
    assert at("a1\nb2\n\n \t\nc3\nd4") == ["c3\n"]
    assert at("a1\n# h\nb2\n####### x\n#y") == ["# h"]
    assert at("a1\n  | 1 |\n| 2 |\nb2\n| 3 |") == ["  |", "| 3"]
    assert at("---\r\nk: v\r\n---\r\nbody") == ["bod"]
    assert at("---\nk: v\nno end") == [] and at("---x\n---\nb") == []
    assert C.block_starts("\n\nx") == [0, 2] and C.block_starts("x\n\n  ") == [0]


def test_long_blocks_are_cut_behind_sentences():
    """The last sentence that ends within SOFT, with its white space if that fits; else SOFT, behind a CR LF."""
    s = "x" * 3900 + ". " + "y" * 3000
    assert C.spans(s) == [(0, 3902), (3902, 6902)]
    assert C.spans("x" * 3999 + ".  " + "y" * 3000) == [(0, 4000), (4000, 7002)]
    assert C.spans("x" * 3997 + ".  " + "y" * 3000) == [(0, 4000), (4000, 7000)]
    assert C.spans("x" * 9000) == [(0, 4000), (4000, 8000), (8000, 9000)]
    assert C.spans("x" * 3999 + "\r\n" + "y" * 3000) == [(0, 4001), (4001, 7001)]
    assert C.spans("x" * 5000) == [(0, 5000)]  # a block between SOFT and HARD stays whole
    assert C.spans("x" * 3000 + ".y" + "z" * 4000) == [(0, 4000), (4000, 7002)]  # no white space behind the mark
    assert C.spans("a" * 3990 + "\n\n" + "b" * 300) == [(0, 4292)]  # a short tail joins


def test_chunk_addresses(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("s\u0001", "t" * 10)], "ref string, text string")
    version = ids.source_version(F.col("ref"), "body", F.col("text"))
    row = C.with_refs(C.chunks(df, "ref", "text", version), "ref").first()
    plain = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    layer = {"layer_id": "body", "text_ref": "s\u0001#body", "text_sha256": hashlib.sha256(b"t" * 10).hexdigest(), "origin": "record", "provenance_sha256": None}
    assert row.version == plain({"v": 1, "source_ref": "s\u0001", "layers": [layer]})
    assert row.chunk_digest == plain(["s\u0001", row.version, "body", 0, 10, "chunk-1"]) and row.chunk_ref == "chk:" + row.chunk_digest[:32]


def test_pack_takes_more_rows_than_one_step(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(5000)], "i long, c long")
    got = P.prefix(rows, [], [F.col("i")], "c", 1300).agg(F.count("*"), F.max("running")).first()
    assert tuple(got) == (2601, 1300) and P.prefix(rows, [], [F.col("i")], "c", 10**6).count() == 5000


def test_expand_bounds(spark):
    rows = [("hub", f"n{i:03d}", "k") for i in range(30)] + [("a", "hub", "k"), ("a", "b", "k"), ("b", "c", "k")]
    got = {r.node: r.depth for r in G.expand(spark.createDataFrame(rows, "src string, dst string, kind string"), ["a"]).collect()}
    assert got == {"a": 0, "b": 1, "hub": 1, "c": 2}  # the hub is a leaf
    got = G.expand(spark.createDataFrame(rows, "src string, dst string, kind string"), ["hub"], depth=1)
    assert got.count() == 1 + G.FAN_OUT


def test_bm25_prefers_rare_and_short(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha " + "pad " * 50), (3, "gamma delta"), (4, "delta")], "id long, text string")
    hits = S.top(S.bm25(rows, "id", "text", ["alpha"]), 10, F.col("score"), F.col("id")).orderBy("rank").collect()
    assert [r.id for r in hits] == [1, 2]


def test_ladder_steps(spark):
    rows = spark.createDataFrame([(1, "x the wide river", "g"), (2, "wide river", "g"), (3, "river", "h")], "id long, text string, g string")
    got = {(r.id, r.step) for r in S.ladder(rows, "id", "text", "the wide river", "g").collect()}
    assert got == {(1, 1), (3, 4)}


def test_claim_order(spark):
    rows = spark.createDataFrame([(1, "river bank flood", "the river and its bank before the flood"), (2, "flood bank river", "the river and its bank before the flood"), (3, "none such words", "river")], "id long, c string, p string")
    assert {r.id: r.verdict for r in E.claim_support(rows, "id", "c", "p").collect()} == {1: "supported", 2: "partial", 3: "unsupported"}


def test_batches_join_short_tail(spark):
    rows = spark.createDataFrame([(f, i) for f, n in (("a", 25), ("b", 20), ("c", 5)) for i in range(n)], "f string, i long")
    got = {(r.f, r.batch): r["count"] for r in V.plan_batches(rows, "f", ["i"]).groupBy("f", "batch").count().collect()}
    # c is too short for a batch of its own and joins the last one of b
    assert got == {("a", 0): 12, ("a", 1): 13, ("b", 2): 12, ("b", 3): 8, ("c", 3): 5}
    short = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "f string, i long")
    assert {r.batch for r in V.plan_batches(short, "f", ["i"]).collect()} == {0}


def test_stream_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).coalesce(1).write.parquet(src)
    write = incremental.append_once(out, "k")
    incremental.run_available(incremental.new_files(spark, src, schema), ck, write)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    incremental.run_available(incremental.new_files(spark, src, schema), ck, write)
    assert spark.read.parquet(out).count() == 3


def test_suffix_join_takes_the_least_ident_of_equal_paths(spark):
    """Equal paths under several idents, in any order: the least one, never that which came last; null paths and idents name nothing."""
    from textloom.operators import records as R

    for idents in ([1, 5, 9], [9, 5, 1], [5, 9, 1]):
        names = spark.createDataFrame([(i, "http://a/x") for i in idents] + [(0, "http://b/x"), (-1, None), (None, "http://a/x")], "ident long, url string").coalesce(1)
        got = R.by_suffix(spark.createDataFrame([("z/x",), ("z/y",)], "path string"), "path", names, "url", "ident")
        assert {r.path: r.ident for r in got.collect()} == {"z/x": 1, "z/y": None}


def test_orphans_meet_each_target_once(spark):
    """Many edges into one node are one row of the join, not one each."""
    e = spark.range(500).select(F.col("id").cast("string").alias("src"), F.lit("hub").alias("dst"))
    got = G.orphans(spark.createDataFrame([("hub",), ("x",), (None,), ("x",)], "node string"), e)
    assert sorted(str(r.node) for r in got.collect()) == ["None", "x", "x"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftAnti") :]


def test_chunks_by_few_rows_and_without_texts(spark):
    """More rows than a worker holds at once, null and empty texts: the same chunks, with texts or without them."""
    texts = [None, "", "short", "# a\n\n" + "word. " * 1500] * (C.FEW // 2)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = C.chunks(df, "id", "text")
    assert sorted((r.id, r.start_char, r.end_char, r.text) for r in got.collect()) == [(i, a, b, t[a:b]) for i, t in enumerate(texts) for a, b in C.spans(t or "")]
    bare = C.chunks(df, "id", "text", with_text=False)
    assert "text" not in bare.columns and sorted(map(tuple, bare.collect())) == sorted(map(tuple, got.drop("text").collect()))
