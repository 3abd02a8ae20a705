"""Cases that an operator once left out or took too often."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import components, decontamination, language_id, mixing, ngram_jaccard, quality_classifier, samples, secret_scan, substring_dedup, token_output, url_filters, words


def test_mixed_shares_by_id_source_and_size(spark):
    """Null and repeated ids of different sizes, some in two sources: each row comes as often as the mix takes it."""
    say = lambda word, n: " ".join([word] * n)
    rows = [(None, say(f"n{i}", 3 + i), "a") for i in range(12)] + [(7, say(f"r{i}", 2 + 5 * i), "bc"[i % 2]) for i in range(10)] + [(8, say("same", 4), "a"), (8, say("same", 4), "c"), (8, say("more", 4), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, had, got = Counter(), Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r.size] += r.taken
    for i, t, s in rows:
        had[i, t, s] += 1
    for r in mixing.mixed(df).collect():
        got[r.doc_id, r.text, r.source] += 1
    assert all(k in had and n <= 2 * had[k] for k, n in got.items())
    words = Counter()
    for (i, t, s), n in got.items():
        words[i, s, len(t.split())] += n * len(t.split())
    assert words == +want and len(set(got.values())) > 1


def test_secret_behind_a_short_core(spark):
    """A tagged word whose secret stands behind a quote: every core of the run is looked at."""
    ws = words.tokenize(pa.array(['x value="A1b2C3d4E5f6G7h8" y'], pa.string()))
    raw = ws.data.tobytes()
    found = list(secret_scan.added_spans(ws, np.array([0, 1, 0]), raw, {}))
    assert [(d, raw[s:e]) for d, s, e in found] == [(0, b"A1b2C3d4E5f6G7h8")]


def thue_morse(n, a, b):
    """Two words of 2 ** n letters that polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_hashes_tell_mirrored_words_apart():
    for n in (5, 7, 9, 11, 12):
        pair = thue_morse(n, "a", "b")
        for seed in (0, 1):
            h = words.tokenize(pa.array([" ".join(pair)])).hashes(seed)
            assert h[0] != h[1]
    a, b = thue_morse(11, "x ", "y ")
    ws = words.tokenize(pa.array([a, b]))
    assert words.runs(ws.hashes()[: ws.first[1]], 2048)[0] != words.runs(ws.hashes()[ws.first[1] :], 2048)[0]


def test_runs_equal_only_for_equal_words():
    r = np.random.RandomState(2)
    text = " ".join(r.choice(list("ab"), 400))
    ws = words.tokenize(pa.array([text]))
    w = text.split()
    for size in (1, 2, 3, 5, 10, 13, 20):
        got, at = ws.windows(ws.hashes(), size)
        keys = [tuple(w[i : i + size]) for i in at.tolist()]
        assert len(at) == 401 - size and len(set(got.tolist())) == len(set(keys)) == len(set(zip(got.tolist(), keys)))


def test_substrings_by_row(spark):
    """One id with several texts, string and null ids, the largest id, words of mirrored letters: each row against brute force."""
    say = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    a, b = thue_morse(10, "a", "b")
    rows = [(0, say("t", 30)), (1, say("t", 30)), (1, say("o", 30)), (1, say("o", 25) + " x"), (2, " ".join([a] * 19 + ["z"])), (3, " ".join([b] * 19 + ["z"])), (None, say("o", 40)), (2**63 - 1, say("o", 40)), (None, None), (5, None), (1, say("o", 30))]
    want = brute.dedup(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(df).collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert not any(r.n_removed for r in substring_dedup.digests(df.where("doc_id in (2, 3)")).collect())
    named = substring_dedup.digests(df.where("doc_id < 2").selectExpr("concat('d', doc_id) as doc_id", "text")).collect()
    assert {r.doc_id for r in named} == {"d0", "d1"} and sum(r.n_removed for r in named) >= 30 + 25


def test_planted_secrets_of_unseen_formats(spark):
    """The field finds nine in ten of values that no pattern knows, and hardly anything else."""
    r = random.Random(4)
    some = lambda n, x="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(x) for _ in range(n))
    say = lambda n: " ".join(some(r.randint(2, 9), "aeioulnrstdm") for _ in range(n))
    known = [say(30) + f' token = "{some(40, "0123456789abcdef")}" ' + say(10) for _ in range(60)] + [say(20) + " AKIA" + some(16, "ABCDEFGH0123456789") + " " + say(9) for _ in range(40)]
    known += [say(30) + f" in {r.randint(1900, 2030)} at {some(5)}.{r.randint(0, 9)}@mail.example.com " + say(5) for _ in range(60)]
    model = secret_scan.fit(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string"))
    formats = [lambda: "ghp_" + some(36), lambda: "AIza" + some(35), lambda: "xox-" + some(12, "0123456789") + "-" + some(24), lambda: some(32)]
    rows, spots = [], {}
    for i in range(200):
        front, value = say(r.randint(3, 20)) + " ", formats[i % 4]() if i < 100 else f"{some(6)}.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.org"
        if i % 3 == 0 and i < 100:
            front += "bearer "
        rows.append((i, front + value + " " + say(9)))
        spots[i] = f"crf:{len(front)}:{len(front) + len(value)}"
    got = {x.doc_id: x.spans for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    found = sum(spots[i] in got[i] for i in range(100))
    assert found >= 90 and sum(bool(got[i]) for i in range(100, 200)) <= 5


def test_many_spans_in_one_text_take_linear_time():
    text = "x ".join(f'password="abcdefgh{i:08d}"\n' for i in range(40_000))
    ws, raw = words.tokenize(pa.array([text])), text.encode()
    began = time.time()
    base = {0: secret_scan.base_spans(raw)}
    assert len(base[0]) == 40_000 and not list(secret_scan.added_spans(ws, np.ones(len(ws.start), np.int8), raw, base))
    assert time.time() - began < 5


def test_switched_languages(spark):
    """Runs of words of spliced lines get their own labels."""
    r = np.random.RandomState(0)
    own = {"en": ["the", "and", "thing", "other", "with", "shing"], "fr": ["le", "école", "été", "eaux", "que", "ouè"]}
    known = [(i, y, " ".join(r.choice(own[y], 40))) for i in range(80) for y in (("en", "fr")[i % 2],)]
    model = language_id.train(known)
    front, back = " ".join(r.choice(own["en"], 9)), " ".join(r.choice(own["fr"], 7))
    df = spark.createDataFrame([(1, front + " " + back), (2, None), (3, "12 !"), (4, "")], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in language_id.spans(df, model).collect()}
    assert got == {1: [("en", 0, len(front)), ("fr", len(front) + 1, len(front) + 1 + len(back))], 2: [], 3: [], 4: []}


def test_samples_are_bounded_and_one_job(spark):
    """Many labels, one long text, null ids and labels: the sample stays within its bounds."""
    rows = [(i, "y" * 10, f"l{i % 90}") for i in range(900)] + [(1000, "x" * 60_000, "l1"), (None, "z", "l1"), (1001, None, "l1"), (1002, "w", None)]
    df = spark.createDataFrame(rows, "i long, t string, l string")
    got = samples.by_label(df, "i", "t", F.col("l"), 5)
    assert len({y for _, y, _ in got}) == samples.MAX_LABELS and max(Counter(y for _, y, _ in got).values()) <= 5 and all(t == "y" * 10 for *_, t in got)
    assert len(samples.within(got, 64 * 20)) <= 128 and samples.within([], 5) == []


def test_tokens_of_mirrored_and_long_words(spark):
    """Units whose polynomial hashes would be equal, and units of thousands of bytes, against the plain tokenizer."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    texts = [x for n in (9, 11) for x in thue_morse(n, "a", "b")] + [" ".join(thue_morse(6, "a", "b")), "w" * 5000 + " end", " é" * 300, "x" * 256 + " " + "y" * 257, "it's a\u00a0b  ", None]
    with open(path, "rb") as f:
        encoder = token_output.Encoder(f.read())
    tk = Tokenizer.from_file(path)
    for _ in range(2):  # the second time from the cache
        got = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in got] == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    # a cache that holds another unit under a unit's hash is noticed
    encoder.bytes[: encoder.filled] ^= 1
    got = encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_one_hot_id_fills_many_shards(spark, tmp_path, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    rows = [(7, f"t {i}") for i in range(400)] + [(None, "n")] * 30 + [(9, "last one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "t")
    out = token_output.digests(df, str(P.path("byte_bpe_50k.json")), path=path).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None] * 30 + [7] * 400 + [9]
    sizes = [r.n_docs for r in spark.read.parquet(path).collect()]
    assert len(sizes) >= 3 and max(sizes) < 300
    assert token_output.Reader(spark, path).get([9, 8]) == {9: token_output.Reader(spark, path).get([9])[9]}


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_deep_and_hot_urls_end(spark):
    """300 equal urls of 40 parts, and nested ones of every depth with both labels."""
    deep = "/".join(f"part{i}" for i in range(40))
    rows = [(i, f"http://a.b.c/{deep}") for i in range(300)]
    rows += [(1000 + 40 * j + i, f"http://h{j}.net/" + "/".join(f"n{k}" for k in range(i + 1))) for j in range(8) for i in range(40)]
    rules = (("block", "a.b.c", "/part0/"), *[(("block", "allow")[j % 2], f"h{j}.net", "/n0/") for j in range(8)])
    began = time.time()
    got = {r.page_id: r.verdict for r in url_filters.judge(urls(spark, rows), rules=rules, min_support=0.02).collect()}
    assert time.time() - began < 60 and all(got[i] == "block" for i in range(300)) and len(got) == 620


def test_withheld_rules_urls_are_blocked(spark):
    """Rules of some spam hosts are withheld: their urls share tokens with known ones, and clean urls do not."""
    r = random.Random(1)
    rows, withheld, clean = [], [], []
    for i in range(900):
        k, kind = r.randrange(30), r.choice(["buy", "cheap-pills", "win"])
        rows.append((i, f"http://spam{k}.shop/{kind}/{r.randrange(9999)}?aff={r.randrange(9)}"))
        if k >= 20:
            withheld.append(i)
    for i in range(900, 2400):
        rows.append((i, f"http://site{r.randrange(60)}.{r.choice(['info', 'org'])}/{r.choice(['read', 'news', 'about'])}/{r.randrange(9999)}"))
        clean.append(i)
    rules = tuple(("block", f"spam{k}.shop", "/") for k in range(20)) + tuple(("allow", f"site{k}.info", "/") for k in range(20))
    got = {x.page_id: x for x in url_filters.judge(urls(spark, rows), rules=rules).collect()}
    assert sum(got[i].verdict == "block" for i in withheld) >= 0.9 * len(withheld)
    assert sum(got[i].verdict == "allow" for i in clean) >= 0.99 * len(clean)
    assert all(got[i].rule is None and got[i].confidence >= 0.8 for i in withheld if got[i].verdict == "block")


def test_mined_rules_equal_every_combination(spark):
    """Against all combinations of tokens counted one by one."""
    import itertools

    r = random.Random(8)
    rows = []
    for _ in range(240):
        items = sorted(x for x in "abcde" if r.random() < 0.5)
        rows.append((items, "block" if {"a", "b"} <= set(items) else r.choice(["allow", "allow", "block"]) if r.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "_items array<string>, _verdict string")
    n, least = sum(v is not None for _, v in rows), max(2, int(sum(v is not None for _, v in rows) * 0.02))
    want = []
    for size in range(1, 6):
        for body in itertools.combinations("abcde", size):
            for label in ("allow", "block"):
                hit = [v for items, v in rows if set(body) <= set(items)]
                a, b, c = hit.count(label), sum(v is not None for v in hit), len(hit)
                if a >= least and a >= 0.8 * b and a * len(rows) >= 1.2 * sum(v == label for _, v in rows) * c:
                    if not any(set(w[0]) < set(body) and w[1] == label and w[2] >= a / b for w in want):
                        want.append((frozenset(body), label, a / b, a))
    assert n and set(url_filters.mine(df, 0.02, 0.8, 1.2)) == set(want) and len(want) > 2


@pytest.mark.parametrize("most", [50_000, 500])
def test_mined_rules_of_urls_of_many_tokens(spark, monkeypatch, most):
    """Twelve tokens that tell something come before x and y, which tell nothing but together; also where FP-growth may list few rules."""
    import itertools

    monkeypatch.setattr(url_filters, "MAX_RULES", most)
    r, names = random.Random(11), [f"n{k:02}" for k in range(12)] + ["x", "y"]
    rows = []
    for k in range(300):
        v = ("block", "allow")[k % 2]
        some = ["x", "y"] if v == "block" and k % 4 else r.choice([["x"], ["y"]]) if v == "allow" else []
        rows.append((r.sample(names[:12], 10 if len(some) == 2 else 4) + some, v if k % 10 else None))
    n, total, least = sum(v is not None for _, v in rows), len(rows), max(2, int(sum(v is not None for _, v in rows) * 0.05))
    has = {t: np.array([t in items for items, _ in rows]) for t in names}
    of = {v: np.array([w == v for _, w in rows]) for v in ("allow", "block")}
    want = []
    for size in range(1, len(names) + 1):
        for body in itertools.combinations(names, size):
            hit = np.logical_and.reduce([has[t] for t in body])
            b, c = int((hit & (of["allow"] | of["block"])).sum()), int(hit.sum())
            for label, its in of.items():
                a = int((hit & its).sum())
                if a >= least and a >= 0.8 * b and a * total >= 1.5 * int(its.sum()) * c:
                    if not any(w[1] == label and w[2] >= a / b and w[0] < set(body) for w in want):
                        want.append((frozenset(body), label, a / b, a))
    df = spark.createDataFrame(rows, "_items array<string>, _verdict string")
    got = url_filters.mine(df, 0.05, 0.8, 1.5)
    assert n < total and frozenset("xy") in {w[0] for w in want} and set(got) == set(want)


def test_urls_of_every_awkward_kind(spark):
    """Repeats, nulls, clashing columns: defined verdicts."""
    df = spark.createDataFrame([(1, "http://x.com/en/1", "q", "z"), (1, "http://x.com/en/1", "q", "z"), (None, None, "q", "z"), (3, "://", "q", "z"), (4, "http:///p", "q", "z"), (5, "", "q", "z")], "page_id long, url string, host string, _items string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect())
    assert got == Counter({(1, "x.com", "/en/1", "com/en/", "block"): 2, (None, "", "", None, "allow"): 1, (3, "", "", None, "allow"): 1, (4, "", "/p", None, "allow"): 1, (5, "", "", None, "allow"): 1})


def test_jaccard_with_small_blocks_and_hot_keys(spark, monkeypatch):
    """Every key hot, blocks of two, copies of pivots and blocks for three documents each: still brute force's components."""
    r = np.random.RandomState(4)
    rows, base = [], [[f"b{k}w{i}" for i in range(60)] for k in range(3)]
    for k in range(120):
        w = list(base[k % 3])
        for _ in range(r.randint(0, 9)):
            w[r.randint(60)] = f"e{r.randint(40)}"
        rows.append((k, " ".join(w[: 60 - r.randint(0, 12)])))
    rows += [(200 + k, " ".join(base[0][:50] + [f"x{k}y{i}" for i in range(r.randint(5, 14))])) for k in range(30)] + [(300, None), (301, "")]
    want = brute.components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, meet, least in ((64, 256, 1000), (2, 3, 1), (5, 2, 3)):
        monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
        monkeypatch.setattr(ngram_jaccard, "MEET", meet)
        monkeypatch.setattr(components, "LEAST_HOT", least)
        monkeypatch.setattr(components, "MOST_HOT", 10**9)
        assert {x.doc_id: x.component_id for x in ngram_jaccard.groups(df).collect()} == want


def test_unlinked_family_makes_few_rows(spark, monkeypatch):
    """1,500 documents of three quarters of common text, none linked: the matrix stays small, and nothing is linked."""
    common = [f"c{i}" for i in range(88)]
    rows = [(k, " ".join(common + [f"k{k}o{i}" for i in range(16)])) for k in range(1500)]
    sizes, saved = {}, ngram_jaccard.saved

    def counted(df, name):
        out = saved(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        if name == "matrix":
            sizes["tokens"], sizes["blocks of a token"] = (out.groupBy("token").count().agg(F.count("*"), F.max("count")).first())
        return out

    monkeypatch.setattr(ngram_jaccard, "saved", counted)
    got = {x.doc_id: x.component_id for x in ngram_jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: k for k in range(1500)}
    # rows a token: the square of the blocks that hold it, which lie in homes of sqrt(members) blocks
    assert sizes["blocks of a token"] ** 2 * sizes["tokens"] <= 21 * 1500 and sizes["met"] <= 1500 and sizes["pairs"] <= 3000, sizes


def test_deduplicate_keeps_one_of_equal_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t, "a"), (1, t, "a"), (2, t, "b"), (3, "other words", "c"), (3, "other words", "c"), (None, t, "d"), (4, None, "e"), (4, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted((str(r.doc_id), r.text or "", r._id) for r in ngram_jaccard.deduplicate(df).collect())
    assert got == sorted([("1", t, "a"), ("3", "other words", "c"), ("None", t, "d"), ("4", "", "e")])


def test_empty_tables(spark, empty, frame):
    """Empty documents, labels and benchmark: empty results, or none found."""
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    assert language_id.identify(empty).count() == secret_scan.scan(empty).count() == quality_classifier.classify(empty, labels).count() == decontamination.scan(empty, bench).count() == 0
    assert {r.score for r in quality_classifier.classify(frame, labels).collect()} == {0.5}
    assert decontamination.scan(frame, bench).where("n_hit > 0 or contaminated").count() == 0
    assert ngram_jaccard.deduplicate(empty).count() == substring_dedup.remove(empty).count() == 0


def test_repeated_rows_get_equal_rows(spark, frame):
    """Every row twice, columns with the names of results: each row's twin is like it."""
    twice = frame.withColumn("score", F.lit("z")).unionAll(frame.withColumn("score", F.lit("z")))
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    for df in (language_id.identify(twice), secret_scan.scan(twice), decontamination.scan(twice, bench), quality_classifier.classify(twice, spark.createDataFrame([(8, 1), (9, 0)], "doc_id long, quality int"))):
        rows = Counter(map(tuple, df.collect()))
        assert sum(rows.values()) == 2 * frame.count() and all(n % 2 == 0 for n in rows.values())


def test_quality_learns_from_every_labelled_document(spark):
    """Only texts of over 50,000 characters, which were left out of training before, tell one label from the other; rows in any order, equal scores."""
    r = np.random.RandomState(6)
    text = lambda mark: mark.join(r.choice(["thing", "other", "and", "the", "of"], 9_000))
    rows = [(i, text(" ") if i % 2 else text("!! ")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    assert min(len(t) for _, t in rows) > 30_000 and sum(len(t) > samples.MAX_CHARS for _, t in rows) >= 20
    runs = [{x.doc_id: (x.score, x.predicted) for x in quality_classifier.classify(spark.createDataFrame(rows[::way], "doc_id long, text string").repartition(n), labels).collect()} for way, n in ((1, 1), (-1, 7))]
    assert runs[0] == runs[1] and all(runs[0][i][1] == i % 2 for i in range(40))


def test_values_of_a_rank(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "FEW", 5)
    r = np.random.RandomState(7)
    values = np.concatenate([r.standard_normal(300), np.repeat(r.standard_normal(3), 50)])
    df = spark.createDataFrame([(k % 2, float(x)) for k, x in enumerate(values)], "y int, s double")
    assert [quality_classifier._ranked(df, k) for k in (0, 200, 449)] == np.sort(values)[[0, 200, 449]].tolist()
