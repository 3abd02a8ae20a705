"""Hash trees, checked appends and line differences."""

import hashlib
import random
import time

import pytest

from textloom.functions import lines
from textloom.operators import appends as A
from textloom.operators import hash_tree as H


def by_hand(rows, width):
    level = [hashlib.sha256(f"{p}:{d or ''}".encode()).hexdigest() for p, d in sorted(r for r in rows if r[0] is not None)]
    depth = 0
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)]
        depth += 1
    return level[0] if level else None, depth if level else None


def test_roots(spark):
    r = random.Random(3)
    for n, width in ((0, 4), (1, 4), (4, 4), (5, 4), (700, 8)):
        rows = [(f"p{r.random()}", r.choice([None, "x", "y"])) for _ in range(n)] + [(None, "z")]
        df = spark.createDataFrame(rows, "path string, digest string").repartition(5)
        got = H.root(H.tree(df, "path", "digest", width)).first()
        assert (got["hash"], got["levels"]) == by_hand(rows, width) and got["leaves"] == n


def test_differences_of_trees(spark):
    r = random.Random(4)
    old = {f"{i:05d}": str(r.random()) for i in range(600)}
    for change in (lambda x: x.update({"00007": "n", "00550": "n"}), lambda x: (x.pop("00100"), x.update({"00300a": "n"})), lambda x: x.clear(), lambda x: None):
        new = dict(old)
        change(new)
        a, b = (H.tree(spark.createDataFrame(list(x.items()), "path string, digest string").repartition(3), "path", "digest", 8) for x in (old, new))
        got = {(x.path, x.change) for x in H.differing(a, b, 8).collect()}
        assert got == {(p, "added") for p in new.keys() - old.keys()} | {(p, "removed") for p in old.keys() - new.keys()} | {(p, "changed") for p in old.keys() & new.keys() if old[p] != new[p]}


REQUEST, SOURCE = "source string, version string, expected long, key string, body string", "source string, version string"


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path, sources = str(tmp_path / "log"), spark.createDataFrame([("s", "v"), ("t", "v")], SOURCE)
    ask = lambda key, *more: spark.createDataFrame([("s", "v", 0, key, key), *more], REQUEST)
    real, other = A.create_next, []

    def late(session, where, number, folder):
        if not other:  # another writer commits while this one is about to
            other.append(None)
            other.append(A.append_annotations(ask("fast"), sources, path).collect())
        return real(session, where, number, folder)

    monkeypatch.setattr(A, "create_next", late)
    slow = A.append_annotations(ask("slow", ("t", "v", 0, "own", "x")), sources, path).collect()
    assert [(r.outcome, r.revision) for r in other[1]] == [("stored", 1)]
    assert {r.source: r.outcome for r in slow} == {"s": "conflict", "t": "stored"}
    number, rows = A.snapshot(spark, path, A.ANNOTATIONS)
    assert number == 2 and {(r.source, r.revision, r.key) for r in rows.collect()} == {("s", 1, "fast"), ("t", 1, "own")}
    monkeypatch.setattr(A, "create_next", lambda *a: False)
    with pytest.raises(A.Busy):
        A.append_annotations(spark.createDataFrame([("t", "v", 1, "again", "x")], REQUEST), sources, path, tries=2)
    assert A.snapshot(spark, path, A.ANNOTATIONS)[0] == 2


def test_requests_of_one_call(spark, tmp_path):
    path, sources = str(tmp_path / "log"), spark.createDataFrame([("s", "v"), ("t", "v"), ("none", None)], SOURCE)
    asked = [("s", "v", 0, "b", "x"), ("s", "v", 0, "a", "y"), ("s", "v", 0, "a", "y"), ("s", "v", 0, "a", "z"), ("t", "old", 0, "k", "x"), ("none", "v", 0, "k", "x"), ("gone", "v", 0, "k", "x"), ("t", "v", 3, "l", "x"), (None, "v", 0, "k", "x"), ("t", "v", 0, None, "x"), ("t", "v", 0, "m", None)]
    got = sorted((str(r.source), str(r.key), r.outcome) for r in A.append_annotations(spark.createDataFrame(asked, REQUEST), sources, path).collect())
    assert [g for g in got if g[0] in ("gone", "none", "None")] == [("None", "k", "bad_request"), ("gone", "k", "not_found"), ("none", "k", "stale")]
    assert [g for g in got if g[0] == "t"] == [("t", "None", "bad_request"), ("t", "k", "stale"), ("t", "l", "conflict"), ("t", "m", "bad_request")]
    # the least digest of a key is its first
    assert sorted(g[2] for g in got if g[:2] == ("s", "a")) in (["key_conflict", "replay", "stored"], ["key_conflict", "key_conflict", "stored"]) and ("s", "b", "conflict") in got
    again = A.append_annotations(spark.createDataFrame([("s", "v", 1, "c", "x")], REQUEST), sources, path).first()
    assert (again.outcome, again.revision) == ("stored", 2)


def test_reviews_are_added(spark, tmp_path):
    path, notes = str(tmp_path / "log"), spark.createDataFrame([("s", 1), ("s", 2)], "source string, revision long")
    asked = [("s", 1, "confirmed", " me ", None), ("s", 1, "confirmed", "me", "n"), ("s", 3, "rejected", "me", None), ("s", 1, "maybe", "me", None), ("s", 1, "rejected", " ", None), ("s", 2, "rejected", "me", "n" * 501), ("s", 0, "rejected", "me", None)]
    df = spark.createDataFrame(asked, "source string, revision long, decision string, actor string, note string")
    assert sorted(r.outcome for r in A.append_reviews(df, notes, path).collect()) == ["bad_request"] * 4 + ["not_found"] + ["stored"] * 2
    assert [r.actor for r in A.snapshot(spark, path, A.REVIEWS)[1].collect()] == ["me", "me"]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@pytest.mark.parametrize("steps", [0, 8])
def test_common_lines(monkeypatch, steps):
    monkeypatch.setattr(lines, "STEPS", steps)
    r = random.Random(5)
    for _ in range(800):
        k = r.choice([1, 2, 5, 30])
        a = [r.randrange(k) for _ in range(r.randint(0, 90))]
        b = [r.randrange(k) for _ in range(r.randint(0, 90))] if r.random() < 0.5 else [x for x in a if r.random() < 0.8]
        assert lines.common_lines(a, b) == longest(a, b)


def test_a_million_lines():
    r = random.Random(6)
    a = [f"l{i % 700_000}" for i in range(1_000_000)]
    b = list(a)
    for _ in range(100):
        b[r.randrange(len(b))] = "new"
    began = time.time()
    assert lines.common_lines(a, b) >= 999_900 and time.time() - began < 30


def test_changed_lines_of_texts(spark):
    rows = [(0, None, None, 0), (1, "a\nb", "a\nc", 2), (2, "", "a\nb\n", 2), (3, "a\0", "b", 0), (4, "a\r\nb", "a\nb", 0), (5, "x\n" * 9, "x\n" * 4, 5)]
    df = spark.createDataFrame([r[:3] for r in rows], "i long, a string, b string")
    assert {r.i: r.n for r in df.select("i", lines.changed_lines("a", "b").alias("n")).collect()} == {r[0]: r[3] for r in rows}
