"""Requests, cursors, references; text helpers; the index under bounded runs."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import annotations as A
from textloom.operators import index as I
from textloom.operators import planning as P



def test_requests(spark):
    good = {"query": " a "}
    bad = ["{}", '{"query": " "}', json.dumps({"query": "a" * 1001}), '{"query": 5}', '{"query": "a", "limit": 0}', '{"query": "a", "limit": true}', '{"query": "a", "limit": "3"}', '{"query": "a", "limit": 1.5}', '{"query": "a", "limit": 51}', '{"query": "a", "scope": "x"}', '{"query": "a", "cursor": ""}', "[1]", "no json", None]
    rows = [(0, json.dumps(good)), (1, json.dumps({"query": "b", "limit": 50, "cursor": None, "scope": "captures"})), (2, '{"query": "a", "depth": 1, "more": 2}'), *enumerate(bad, 10)]
    got = {r.id: r for r in P.checked(spark.createDataFrame(rows, "id long, r string"), "id", "r").collect()}
    assert tuple(got[0])[1:] == (None, "", "a", "all", 10, 4000, None) and tuple(got[1])[1:] == (None, "", "b", "captures", 50, 4000, None)
    assert (got[2].error, got[2].wrong, got[2].query) == ("E_UNKNOWN_ARGUMENT", "depth,more", None)
    assert {got[i].error for i in range(10, 10 + len(bad))} == {"E_BAD_ARGUMENTS"}
    assert [got[i].wrong for i in (10, 14, 15, 19)] == ["query", "limit", "limit", "scope"]


@pytest.mark.parametrize(("text", "want"), [("report-1402.pdf", '"report 1402 pdf"'), ('"a-b.c" -no-t pre-f*', '"a-b.c" -no-t pre-f*'), ("", ""), ('  x  a_b"c d"e-f ', 'x "a b""c d""e f"'), ("--- ./. a-", "--- ./. a-"), (None, None), ("é-ü", '"é ü"')])
def test_phrases(spark, text, want):
    assert one(spark, text, P.phrases(F.col("t"))) == want


def test_references(spark):
    chunk = "chk:" + "0" * 32
    assert one(spark, f"see rec:abc-1, {chunk} rec:abc-1 and cap-20240101-120000-ab12 my-note plainword", P.references(F.col("t"))) == ["rec:abc-1", chunk, "cap:cap-20240101-120000-ab12", "rec:my-note"]


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_pages(spark, kind):
    rows = spark.range(10).select(F.when(F.col("id") != 4, F.col("id") if kind != "date" else F.date_add(F.lit("2024-01-01"), F.col("id").cast("int"))).cast(kind).alias("k"))
    token, seen = None, []
    while True:
        part, token = P.page(rows, "k", 4, 7, token)
        seen += [r.k for r in part.collect()]
        if token is None:
            break
    assert seen == sorted(r.k for r in rows.where("k is not null").collect())
    _, token = P.page(rows, "k", 4, 7)
    for bad, g in ((token, 8), ("x" * 9, 7), ("", 7), ("!!", 7)):
        with pytest.raises(ValueError):
            P.page(rows, "k", 4, g, bad)


def one(spark, value, column, *more):
    return spark.createDataFrame([(value, *more)], "t string" + "".join(f", a{i} int" for i in range(len(more)))).select(column).first()[0]


@pytest.mark.parametrize("text", ["", "abc", "ä" * 9, "x😀😀😀😀", "ab€€€€€", "�" * 8, None])
@pytest.mark.parametrize("most", [4, 5, 6, 7, 8, 9, 10, 11])
def test_clip_bytes(spark, text, most):
    want = None if text is None else text.encode()[:most].decode(errors="ignore")
    assert one(spark, text, T.clip_bytes(F.col("t"), most)) == want


@pytest.mark.parametrize("line", [1, 3, 50, 99, 100])
def test_around_line(spark, line):
    lines = [f"line {i}" for i in range(1, 101)]
    want = "\n".join(lines[max(0, line - 1 - 5) : min(100, line - 1 + 5)])[:40]
    assert one(spark, "\n".join(lines), T.around_line(F.col("t"), F.col("a0"), 5, 40), line) == want


@pytest.mark.parametrize(("text", "want"), [("a\\u0041b", "aAb"), ("\\u005cu0041", "\\u0041"), ("\\ud83d\\ude00", "😀"), ("\\u00e9\\u00E9", "éé"), ("none \\u12", "none \\u12"), ("", ""), (None, None)])
def test_unescape_json(spark, text, want):
    assert one(spark, text, T.unescape_json(F.col("t"))) == want


def test_letter_runs(spark):
    assert one(spark, "Café No.1, STRASSE‌x — ۱۲", T.letter_runs(F.col("t"))) == "caf no 1 strasse x ۱۲"
    assert one(spark, " …**A [ref-1] __b__”. ", T.bare_quote(F.col("t"))).split() == ["A", "b"]


def test_index_bounded_runs(spark, tmp_path):
    """A bounded run indexes the least keys and reports what is left; later runs take up the rest, removals are seen at once."""
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(i, f"word w{i}" if i else None) for i in range(7)], "id long, text string")
    lag = [I.refresh(rows, "id", "text", path, 3).first()["lag"] for _ in range(4)]
    assert lag == [4, 1, 0, 0]
    assert I.search(spark, path, ["word"]).count() == 6 and I.search(spark, path, ["word"], gen=1).count() == 2
    changed = rows.where("id <> 6").withColumn("text", F.when(F.col("id") == 5, "other").otherwise(F.col("text")))
    figures = I.refresh(changed, "id", "text", path).first()
    assert (figures["documents"], figures["indexed"], figures["lag"]) == (6, 1, 0)
    assert sorted(r["key"] for r in I.search(spark, path, ["word"]).collect()) == [1, 2, 3, 4]
    assert [r["key"] for r in I.search(spark, path, ["other"]).collect()] == [5]
    assert I.search(spark, path, ["other"], gen=4).count() == 0  # earlier readers see what they saw
    assert I.search(spark, path, ["nowhere"]).count() == 0


def test_index_empty(spark, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], "id long, text string")
    assert I.refresh(none, "id", "text", path).first()["documents"] == 0
    assert I.search(spark, path, ["word"]).count() == 0


def test_states_of_failures(spark):
    s = spark.createDataFrame([("a", "v1", True, "new"), ("b", None, True, "missing"), ("c", None, True, "x"), ("d", "v1", False, "x")], "k string, v string, t boolean, s string")
    f = spark.createDataFrame([("c",), ("c",)], "k string")
    a = spark.createDataFrame([("a", "v0"), ("a", "v1"), ("a", "v1"), ("d", "v1")], "k string, v string")
    assert dict(A.states(s, f, a, "k", "v", "t", "s").collect()) == {"a": "annotated", "b": "missing", "c": "failed", "d": "no_text"}
