"""The stored index: compaction, pinned readers, racing writers."""

import os

from textloom.operators import appends as A
from textloom.operators import index as I


def scores(spark, path, *terms, gen=None):
    return sorted((r["key"], r["score"]) for r in I.search(spark, path, list(terms), False, gen).collect())


def files(path):
    return sum(f.endswith(".parquet") for d, _, names in os.walk(path) for f in names if "postings" in d)


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")


def test_compaction_keeps_scores_and_pinned_readers(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = {i: f"word w{i % 5} " * (i % 3 + 1) for i in range(20)}
    for k in range(3):
        texts[k] = f"word changed {k}"
        texts.pop(19 - k)
        I.refresh(frame(spark, texts), "id", "text", path)
    before, first = scores(spark, path, "word", "w3", "changed"), scores(spark, path, "word", gen=1)
    many = files(path)
    assert tuple(I.compact(spark, path).first())[0] == 4
    assert scores(spark, path, "word", "w3", "changed") == before and I.postings(spark, path, ["changed"]).count() == 3
    assert I.vacuum(spark, path, pinned=(1,)) == []  # too young
    assert len(I.vacuum(spark, path, pinned=(1,), older=0)) == 2
    assert scores(spark, path, "word", gen=1) == first and scores(spark, path, "word", "w3", "changed") == before
    I.vacuum(spark, path, older=0)
    assert files(path) < many
    texts[3] = "late word"
    I.refresh(frame(spark, texts), "id", "text", path)
    assert [k for k, _ in scores(spark, path, "late")] == [3] and scores(spark, path, "w3", gen=4) != scores(spark, path, "w3", gen=5)
    assert [tuple(r)[0] for r in I.figures(spark, path).collect()] == [1, 2, 3, 4, 5]


def test_two_refreshers_at_once(spark, tmp_path, monkeypatch):
    path, real, other = str(tmp_path / "index"), A.create_next, []

    def late(session, where, number, folder):
        if not other:
            other.append(None)
            I.refresh(frame(spark, {1: "fast one", 2: "same"}), "id", "text", path)
        return real(session, where, number, folder)

    monkeypatch.setattr(A, "create_next", late)
    figures = I.refresh(frame(spark, {1: "slow one", 2: "same"}), "id", "text", path).first()
    assert tuple(figures) == (2, 2, 3, 1, 0)  # judged anew: only the changed text is indexed
    assert [k for k, _ in scores(spark, path, "slow")] == [1] and scores(spark, path, "fast") == [] and [k for k, _ in scores(spark, path, "fast", gen=1)] == [1]


def test_a_refresh_without_news_writes_no_postings(spark, tmp_path):
    path = str(tmp_path / "index")
    I.refresh(frame(spark, {1: "a b", 2: ""}), "id", "text", path)
    n = files(path)
    assert tuple(I.refresh(frame(spark, {1: "a b", 2: ""}), "id", "text", path).first()) == (2, 2, 2, 0, 0) and files(path) == n
    I.compact(spark, path)
    assert [k for k, _ in scores(spark, path, "b")] == [1]


def test_terms_are_counted_in_their_row(spark, tmp_path):
    """Counts without a shuffle of terms: one exchange alone, of finished postings, whose tasks stay small."""
    from collections import Counter

    from pyspark.sql import functions as F

    from textloom.operators import index as I

    lists = [None, [], ["a"], sorted("b a b c a b".split()), ["z"] * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "key long, terms array<string>")
    counted = I._counted(df)
    got = {r.key: (r.size, None if r.terms is None else {(x.term, x.tf) for x in r.terms}) for r in counted.collect()}
    assert got[0] == (None, None) and got[1] == (0, None)
    assert all(got[i] == (len(t), set(Counter(t).items())) for i, t in enumerate(lists) if t)
    each = counted.where("size > 0").select("key", "size", F.inline("terms"))
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()
