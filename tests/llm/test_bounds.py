"""User columns of any name, memory and time bounds, orders of ids."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import crf, decontamination, language_id, mixing, ngram_jaccard, periodic_runs, quality_rules, samples, substring_dedup, words

NAMES = ["hits", "a.b", "_c", "_c_text", "_text", "_id", "_hits", "_clean", "kept", "n_words", "_starts", "_key", "contaminated", "c0", "x y", "`q`"]


def wide(spark):
    r = random.Random(1)
    say = lambda n: " ".join(f"word{r.randrange(900)}" for _ in range(n)) + "."
    passage = say(40)
    texts = [None, "", say(120), say(150) + "\nMenu | Home | About |", passage + " " + say(80), say(60) + " " + passage]
    texts += [texts[2], texts[2]]
    rows = [(i, t, "en", "s0", None if t is None else len(t), *[f"{n}={i}" for n in NAMES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([(1, passage)], "item_id long, text string")


@pytest.mark.parametrize("stage", ["clean", "decontaminate", "spans", "remove", "deduplicate", "mixed", "collapse"])
def test_columns_of_any_name(spark, stage):
    docs, benchmark = wide(spark)
    out = {
        "clean": lambda: quality_rules.clean(docs), "decontaminate": lambda: decontamination.decontaminate(docs, benchmark), "spans": lambda: decontamination.decontaminate(docs, benchmark, spans=True),
        "remove": lambda: substring_dedup.remove(docs), "deduplicate": lambda: ngram_jaccard.deduplicate(docs), "mixed": lambda: mixing.mixed(docs), "collapse": lambda: periodic_runs.collapse(docs),
    }[stage]()
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for row in rows:
        at = dict(zip(docs.columns, row))
        assert all(at[n] == f"{n}={at['doc_id']}" for n in NAMES)
        assert (at["lang"], at["source"]) == ("en", "s0")


def test_string_ids_in_their_own_order(spark):
    r = random.Random(2)
    base = " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    ids = ["00", "01", "05", "1", "10", "2", "a", "B", "é"]
    rows = [(i, base if k % 2 == 0 else base + f" tail {i} " + " ".join(f"v{r.randrange(10**6)}" for _ in range(30))) for k, i in enumerate(ids)] + [(None, base)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {(x.doc_id): (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.digests(df).collect()}
    order = {i: k for k, i in enumerate(sorted(ids, key=lambda i: i.encode()))}
    want = brute.dedup([(order.get(i), t) for i, t in rows])
    assert got == {i: want[order.get(i), t] for i, t in rows}
    assert got["00"][1] == 0 and got["01"][1] == 60


def test_one_text_of_each_picked_id(spark):
    rows = spark.range(20_000).select(F.lit("same").alias("i"), F.concat(F.lit("text "), F.col("id") % 50).alias("t"), F.lit("en").alias("l"))
    rows = rows.unionByName(spark.createDataFrame([("other", "x", "fr"), ("other", "y", "de"), ("none", None, "fr")], "i string, t string, l string"))
    got = samples.by_label(rows, "i", "t", F.col("l"), 5)
    assert sorted((i, y) for i, y, _ in got) == [("other", "de"), ("other", "fr"), ("same", "en")]


def test_gradients_of_many_labels_stay_small():
    r = np.random.RandomState(3)
    n, labels = 20_000, 64
    lengths = np.full(n // 20, 20)
    tracemalloc.start()
    w, t = crf.fit(lengths, r.randint(0, 500, n), np.arange(n), 500, r.randint(0, labels, n), labels, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.shape == (500, labels) and np.isfinite(t).all() and peak < 200e6


def test_pair_marginals_equal_enumeration():
    """One step of training moves transitions as the sum over pairs of words says."""
    r = np.random.RandomState(4)
    lengths, labels = np.array([4, 1, 3]), 3
    gold = r.randint(0, labels, 8)
    _, t = crf.fit(lengths, np.zeros(8, np.int64), np.arange(8), 1, gold, labels, steps=1)
    pairs = [(i, i + 1) for i in (0, 1, 2, 5, 6)]
    want = sum((np.eye(labels)[gold[i]][:, None] * np.eye(labels)[gold[j]] - np.full((labels, labels), 1 / labels**2)) for i, j in pairs) / 8
    assert np.allclose(t, 0.3 * want / np.sqrt(1e-8 + want**2), atol=1e-6)


def test_long_lines_by_windows():
    r = np.random.RandomState(5)
    lengths, t = np.array([3, 5000, 0, 700, 512]), r.standard_normal((3, 3))
    scores = r.standard_normal((lengths.sum(), 3))
    whole, _ = crf.forward_backward(crf.Layout(lengths), scores, t)
    assert np.abs(crf.marginals(lengths, scores, t) - whole).max() < 1e-6
    assert (crf.labels(lengths, scores, t) == crf.viterbi(crf.Layout(lengths), scores, t)).mean() > 0.999
    assert crf.windows(np.array([512, 3])) is None


def test_one_very_long_line():
    rows = [(i, "en" if i % 2 else "fr", " ".join(random.Random(i).choice(["the", "and", "of", "was"] if i % 2 else ["le", "et", "de", "que"]) for _ in range(80))) for i in range(20)]
    model = language_id.train(rows)
    began = time.time()
    _, g = language_id.word_marginals(model, pa.array(["the and " * 400_000]))
    assert len(g) == 800_000 and model.labels[int(g.mean(axis=0).argmax())] == "en" and time.time() - began < 20


def test_query_by_the_plain_field(spark, data):
    """The language query against sums over all words of one document at a time, without batches or windows."""
    from textloom.llm import queries as Q

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs.where(~samples.held_out("doc_id", 4, 2))
    model = language_id.train(samples.by_label(kept, "doc_id", "text", F.col("lang"), language_id.TRAIN_DOCS))
    got = {r.doc_id: r for r in Q.op2_language_id(spark, data).collect()}
    for r in docs.collect():
        ws = words.tokenize(pa.array([r.text]), words.SPACED, lower=True)
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        g, _ = crf.forward_backward(crf.Layout(language_id.line_lengths(ws)), model.scores(ws), model.transitions)
        mean = g.mean(axis=0)
        assert got[r.doc_id].lang_pred == model.labels[int(mean.argmax())] and got[r.doc_id].score == pytest.approx(float(mean.max()), abs=1e-5)


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_on_empty_and_wide_tables(spark, tmp_path, empty):
    """All stages in order over rows with nulls, repeats and columns of any name; each keeps the columns, the last gives the token digests."""
    import corpus_pipeline as P

    docs, benchmark = wide(spark)
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, names = (docs.limit(0) if empty else docs), docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == (names if k < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"]), name
        out.write.parquet(f"{tmp_path}/{k}")
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{k}")
        rows = frame.collect()
        assert bool(rows) != empty, name
        if k < 4:
            assert all(r[c] == f"{c}={r['doc_id']}" for r in (dict(zip(names, x)) for x in rows) for c in NAMES), name
    if not empty:
        starts = sorted((r.start, r.n_tokens) for r in rows)
        assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))] and len(rows) == before.count()
