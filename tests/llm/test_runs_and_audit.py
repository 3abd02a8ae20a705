"""Periodic runs and the filter audit against plain versions."""

import random
import time
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from textloom.llm import exact, filter_audit, periodic_runs, words
from textloom.llm import queries as Q


def sequences(count):
    r = random.Random(3)
    for _ in range(count):
        letters, n = r.choice([1, 2, 2, 3, 5]), r.randint(0, 60)
        w = [r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, 8)
            w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else w[i] for i in range(n)]
        yield w


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_of_words(least):
    for w in sequences(600):
        want = brute.runs(w, least)
        assert periodic_runs.runs_of(np.array(w, np.int64), least) == want
        text = " ".join("abcdefg"[x] * (5 * x + 1) for x in w)
        assert periodic_runs.runs_in(words.tokenize(pa.array(["b c a", text, None])), least)[1] == want


def test_runs_survive_colliding_hashes(monkeypatch):
    """A hash that calls everything equal: words decide."""
    monkeypatch.setattr(periodic_runs, "_MOD", 1)
    for w in sequences(200):
        assert periodic_runs.runs_of(np.array(w, np.int64)) == brute.runs(w, 12)


def test_long_runs_take_linear_time():
    for w in ([0] * 300_000, [0, 1] * 150_000, list(range(1000)) * 300):
        began = time.time()
        assert len(periodic_runs.runs_of(np.array(w))) == 1
        assert time.time() - began < 20


def test_numbers_follow_spelling_not_hashes():
    ws = words.tokenize(pa.array(["a bb a ccccccccccc bb ccccccccccd"]))
    ids = exact.numbered(ws, np.zeros(len(ws.start), np.uint64))
    assert [ids.tolist().index(x) for x in ids.tolist()] == [0, 1, 0, 3, 1, 5]


def test_periodic_query(spark, frame, docs, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {r[0]: brute.periodic(r[0], r[1]) for r in docs}
    assert sum(v[0] for v in got.values()) > 3


def test_periodic_query_on_tables(spark, data):
    """The driver's documents of up to 600 words."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, data).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        if len(t.split()) <= 600:
            assert got[i] == brute.periodic(i, t)


def test_collapse_keeps_columns(spark):
    row = ("a b c " * 8 + "d  e", 5, "x", "y", "z")
    df = spark.createDataFrame([row, row, ("plain  text", 6, None, None, None), (None, 7, "", "", ""), ("", 8, "", "", "")], "text string, doc_id long, `a.b` string, runs string, _c string")
    out = periodic_runs.collapse(df)
    assert out.columns == df.columns
    want = [("a b c d e", *row[1:])] * 2 + [tuple(r) for r in df.collect()[2:]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert periodic_runs.collapse(df.limit(0)).count() == 0 and periodic_runs.find(df.limit(0)).count() == 0


def audit_by_hand(rows, marks):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = [brute.filters(i, t, first) for i, t, _ in rows]
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                all_x = sum(x in f for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), all_x - len(gone), sum(f == {x} for _, f in own), sum(marks.get(i, (0, 0))[0] == 1 for i, _ in gone), sum(marks.get(i, (0, 0))[1] == 1 for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_of_awkward_rows(spark, docs):
    rows = [(r[0], r[1], r[2]) for r in docs] + [(None, "same text", "en"), (None, "same text", "en"), (3, "same text", None), (900, "same text", "fr"), (900, "same text", "fr"), (901, None, "fr"), (902, "word " * 250 + "#", ""), (903, "Ab " * 260, "en")]
    rows += [(910 + k, " ".join(f"w{j}" for j in range(260)) + " A" * k, "de") for k in (0, 0, 1, 30)]
    marks = {i: (i % 2, i % 3 == 0) for i in (1, 2, 5, 6, 9, 10, 11, 900, 903)}
    given = [(i, int(q), int(x)) for i, (q, x) in marks.items()] + [(9, 0, 0), (None, 1, 1), (5555, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(filter_audit.profile(df, labels)).collect()}
    assert got == audit_by_hand(rows, marks)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})
    assert filter_audit.audit(filter_audit.profile(df.limit(0), labels)).count() == 0
    bare = filter_audit.audit(filter_audit.profile(df, None, part_col=None))
    assert bare.count() == 600 and bare.agg({"good_lost": "sum"}).first()[0] == 0


def test_distinct_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(words.Words, "hashes", lambda self, seed=0: np.zeros(len(self.start), np.uint64))
    assert filter_audit.counts(pa.array(["a b a c", None, "x x"]))["distinct"].tolist() == [3, 0, 1]


def test_very_long_text():
    text = " ".join(f"w{i % 7919}" for i in range(1_000_000)) + " Ünï #"
    began = time.time()
    c = filter_audit.counts(pa.array([text, "short"]))
    assert {k: int(v[0]) for k, v in c.items()} == {"words": 1_000_002, "distinct": 7921, "capitals": 0, "points": len(text), "marks": 1}
    assert time.time() - began < 20
