"""Aliases, owners and the export of a state."""

import json

from textloom.operators import graph as G
from textloom.sources import files


def test_names_of_one_node(spark):
    e = spark.createDataFrame([("a", "r1", "k"), ("r1", "r2", "k"), ("r2", "a", "k"), ("r1", "n1", "k"), ("n1", "r2", "k"), (None, "a", "k")], "src string, dst string, kind string")
    aliases = spark.createDataFrame([("r1", "n1"), ("r2", "n2"), ("r2", "n9"), (None, "n3")], "ref string, node string")
    assert {tuple(r)[:2] for r in G.canonical(e, aliases).collect()} == {("a", "n1"), ("n1", "n2"), ("n2", "a")}


def test_owners(spark):
    holders = spark.createDataFrame([("b", "rb", ["x", "y"]), ("a", "ra", ["x", "rb"]), ("c", None, None)], "node string, ref string, layers array<string>")
    refs = spark.createDataFrame([("x",), ("y",), ("rb",), ("none",), (None,)], "ref string")
    assert {r.ref: r.owner for r in G.owners(refs, holders).collect()} == {"x": "a", "y": "b", "rb": "b", "none": None, None: None}


def test_state_is_written_in_order(spark, tmp_path):
    artifacts = spark.createDataFrame([("b", "v"), ("a", "v")], "source string, version string")
    parts = spark.createDataFrame([("a", 10, "t"), ("a", 2, None), ("gone", 0, "t")], "source string, at long, text string")
    notes = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("gone", 1, "x")], "source string, revision long, body string")
    path = str(tmp_path / "out")
    files.write_state(files.state_lines(artifacts, parts, notes, {"schema": "1"}).repartition(5), path)
    lines = [json.loads(r.value) for f in sorted(spark.read.text(path).inputFiles()) for r in spark.read.text(f).collect()]
    assert [(x["type"], x.get("source"), x.get("at"), x.get("body")) for x in lines] == [("header", None, None, None), ("artifact", "a", None, None), ("part", "a", 2, None), ("part", "a", 10, None), ("note", "a", None, "new"), ("artifact", "b", None, None)]
