import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import components, decontamination, language_id, mixing, ngram_jaccard, quality_classifier, quality_rules, secret_scan, substring_dedup, token_output, url_filters, words


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# words

def test_words_equal_regular_expressions(docs):
    for table, pattern, lower in ((words.SPACED, brute.SPACED, False), (words.ALNUM, brute.ALNUM, True)):
        ws = words.tokenize(pa.array([d[1] for d in docs], pa.string()), table, lower)
        for k, d in enumerate(docs):
            got = [ws.word(i).decode() for i in range(ws.first[k], ws.first[k + 1])]
            assert got == brute.words(d[1], pattern, lower)


def test_hashes_do_not_depend_on_place():
    ws = words.tokenize(pa.array(["ab cd ab", "cd", "x ab cd ab"]))
    h = ws.hashes()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
    w, at = ws.windows(h, 3)
    assert w[0] == w[2] and at.tolist() == [0, 4, 5]


# 1

def test_quality_base(frame, docs):
    got = by_id(quality_rules.judge(frame), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d[0]: brute.quality(d[1]) for d in docs}


def test_quality_drops_lines_and_documents(frame, docs):
    kept = {r.doc_id: r for r in quality_rules.clean(frame).collect()}
    nav = next(d[0] for d in docs if d[1] and d[1].startswith("Menu |"))
    note = next(d[0] for d in docs if d[1] and "All rights reserved" in d[1])
    assert nav not in kept and "rights" not in kept[note].text and kept[note].n_chars == len(kept[note].text)
    assert quality_rules.clean(frame).columns == frame.columns


def test_quality_empty(empty):
    assert quality_rules.judge(empty).count() == 0


# 2

def test_language(spark):
    r = np.random.RandomState(0)
    en, fr = ["the", "and", "thing", "other", "with", "shing"], ["le", "école", "été", "eaux", "que", "ouè"]
    rows = [(i, " ".join(r.choice(en if i % 2 else fr, 30)), "en" if i % 2 else "fr") for i in range(80)] + [(100, None, "en"), (101, "12 34", None), (102, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(df).collect()}
    assert len(got) == 83 and all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(80))
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())


def test_language_without_labels(frame):
    out = language_id.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in out} == {"und"}


def test_forward_backward_equals_enumeration():
    import itertools

    from textloom.llm import crf

    r = np.random.RandomState(1)
    lengths = np.array([3, 1, 4])
    scores, t = r.randn(8, 2), r.randn(2, 2)
    got, _ = crf.forward_backward(crf.Layout(lengths), scores.copy(), t)
    best = crf.viterbi(crf.Layout(lengths), scores, t)
    at = 0
    for n in lengths:
        paths = {p: sum(scores[at + i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=int(n))}
        z = sum(np.exp(v) for v in paths.values())
        for i in range(n):
            assert abs(got[at + i, 1] - sum(np.exp(v) for p, v in paths.items() if p[i]) / z) < 1e-9
        assert tuple(best[at : at + n]) == max(paths, key=paths.get)
        at += n


# 3

@pytest.mark.parametrize("block", [8_000_000, 400])
def test_decontamination(spark, frame, docs, block):
    long = next(d[1] for d in docs if d[1] and len(d[1].split()) > 4000)
    items = [(0, " ".join(long.split()[100:130])), (1, "One, two!"), (2, None), (None, "an er"), (3, ""), (10, " ".join(docs[9][1].split()[:40])), (10, docs[9][1][-300:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontamination.scan(frame, bench, block_chars=block), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    merged = [(i, t) for i, t in items]
    assert got == {d[0]: brute.contaminated(d[1], merged) for d in docs}
    kept = decontamination.decontaminate(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if not v[4]}
    cut = decontamination.decontaminate(frame, bench, spans=True)
    assert cut.columns == frame.columns


# 4

def test_quality_classifier(spark):
    r = np.random.RandomState(0)
    v = ["thing", "other", "shing", "and", "the", "of"]
    good = [" ".join(r.choice(v, 60)) + "." for _ in range(60)]
    bad = ["!! ".join(r.choice(v, 60)).upper() for _ in range(20)]
    rows = list(enumerate(good + bad)) + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_classifier.classify(df, labels).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(80)) and got[90].score == got[91].score
    assert all((x.score >= 0.3) == (x.predicted == 1) for x in got.values())
    none = quality_classifier.classify(df, labels.where("quality = 1"))
    assert {x.score for x in none.collect()} == {0.5}


# 5

def test_jaccard(frame, docs, spark):
    got = by_id(ngram_jaccard.groups(frame), "n_shingles", "component_id")
    want = brute.components([(d[0], d[1]) for d in docs])
    assert got == {d[0]: (len(brute.shingles(d[1])), want[d[0]]) for d in docs}
    kept = ngram_jaccard.deduplicate(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_jaccard_family_around_the_threshold(spark):
    """Copies with more and more edits: chains of links that no single pivot sees."""
    r = np.random.RandomState(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randint(len(w))] = f"e{r.randint(1000)}"
        rows.append((k, " ".join(w)))
    rows += [(200, rows[0][1]), (201, None), (202, rows[3][1] + " more words at the end of it")]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.groups(df).collect()}
    assert got == brute.components(rows)


def test_jaccard_empty_and_null_ids(spark, empty):
    assert ngram_jaccard.groups(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_jaccard.groups(df).collect() if r.doc_id) == [(3, 3)]
    assert ngram_jaccard.deduplicate(df).count() == 3


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (None, 3), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50}


# 6

def test_substrings(frame, docs):
    got = by_id(substring_dedup.digests(frame), "n_words", "n_removed", "kept_sha256")
    assert got == {i: v for (i, _), v in brute.dedup([(d[0], d[1]) for d in docs]).items()}
    assert substring_dedup.remove(frame).columns == frame.columns


def test_substrings_repeated_rows_and_empty(spark, empty):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.digests(df).collect())
    assert got == [(0, 30), (1, 0), (1, 0), (2, 30)]
    assert substring_dedup.digests(empty).count() == 0


# 7

@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("byte_bpe_50k.json"))


def test_token_round_trip(spark, frame, docs, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "tokens")
    got = by_id(token_output.digests(frame, vocabulary, path=path), "start", "n_tokens", "ids_crc32")
    tk, at, want = Tokenizer.from_file(vocabulary), 0, {}
    for d in docs:
        ids = np.array(tk.encode(d[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want[d[0]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want
    found = token_output.Reader(spark, path).get([5, 9, 10_000, -1])
    assert set(found) == {5, 9} and found[9] == tk.encode(docs[9][1], add_special_tokens=False).ids + [0]


def test_token_repeats_and_empty(spark, vocabulary, empty):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in token_output.digests(df, vocabulary).collect())
    assert got == [(0, 1), (1, 3), (4, 3)]
    assert token_output.digests(empty, vocabulary).count() == 0


def test_index_is_minimal_and_refuses():
    keys = [str(i) for i in range(1000)]
    seeds, slot = token_output.build_index(keys)
    assert sorted(slot.tolist()) == list(range(1000))
    assert token_output.find_slots(seeds, 1000, keys)[0].tolist() == slot.tolist()


# 8

def test_urls(spark):
    rows = [(1, "http://a.example.com/en/123?q=1"), (2, "https://example.com/en/77#x"), (3, "https://B.Example.NET/de/81"), (4, "x.org/es/"), (5, None), (6, "http://badexample.com/en"), (7, "http://org/es/"), (8, "ftp://u.example.net/de/9"), (9, "http://h?x=/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("a.example.com", "/en/123", "com/en/", "block"), 2: ("example.com", "/en/77", "example.com/en/7", "allow"), 3: ("b.example.net", "/de/81", "example.net/de/8", "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("badexample.com", "/en", None, "allow"), 7: ("org", "/es/", "org/es/", "block"), 8: ("u.example.net", "/de/9", "net/de/", "block"), 9: ("h", "", None, "allow"),
    }


def test_urls_verdicts_of_the_contract(spark):
    """One url a rule: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    rows = [(1, "http://a.com/en/1"), (2, "http://example.com/en/7"), (3, "http://a.net/de/1"), (4, "http://u.example.net/de/9"), (5, "http://example.net/de/8"), (6, "http://a.org/es/1")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("net/de/", "allow"), 5: ("example.net/de/8", "block"), 6: ("org/es/", "block")}


def test_urls_mined_rules_block_alike(spark):
    rows = [(i, f"http://spam{i % 20}.shop/buy/{i}") for i in range(60)] + [(100 + i, f"http://site{i}.info/read/{i}") for i in range(60)]
    rules = tuple(("block", f"spam{k}.shop", "/buy/") for k in range(17))
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules, min_support=0.1).collect()}
    assert all(got[i] == "block" for i in range(60)) and all(got[100 + i] == "allow" for i in range(60))


def test_urls_empty(spark):
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 9

def test_secrets_base(frame, docs):
    got = by_id(secret_scan.scan(frame), "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == {d[0]: brute.secrets(d[1]) for d in docs}


def test_secrets_field_adds_keyed_values(spark):
    r = np.random.RandomState(0)
    hexes = ["".join(r.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    keys = ["AKIA" + "".join(r.choice(list("ABCDEFGHIJKLMNOP0123456789"), 16)) for _ in range(30)] + ["password=" + h[:18] for h in hexes[:30]]
    rows = [(i, f"some plain words here token = \"{h}\" and more words 12 of {i} them\nnext {keys[i]} line of text") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"plain text number {i} with few digits 1999 and none") for i in range(60)]
    known = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.fit(known)
    fresh = spark.createDataFrame([(300, "the auth key is QBIAJC5VJ0U4YMB3KXC6 of the thing"), (301, None)], "doc_id long, text string")
    assert {x.doc_id: x.spans for x in secret_scan.scan(fresh, model=model).collect()} == {300: "crf:16:36", 301: ""}
    assert not any("crf" in x.spans for x in secret_scan.scan(known, model=model).collect())


# 10

def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_fit_of_many_sizes_equals_subset_sums():
    """Over 600 size classes: nothing is left out of the dynamic program."""
    r = np.random.RandomState(5)
    sizes = np.array(sorted(r.choice(np.arange(1000, 9000, 4), 900, replace=False)))
    counts = np.ones(900, np.int64)
    counts[:3] = 2
    for budget in (1, 1003, 4002, 9999, 12_346):
        reach = 1
        for z, c in zip(sizes.tolist(), counts.tolist()):
            for _ in range(c):
                reach |= reach << z
                reach &= (1 << (budget + 1)) - 1
        k = mixing.fit(sizes, counts, budget)
        assert (k <= counts).all() and int((k * sizes).sum()) == reach.bit_length() - 1


def test_targets_stop_and_reshare_like_rounds():
    r = np.random.RandomState(6)
    for _ in range(200):
        sizes = r.randint(0, 1000, r.randint(1, 12)).tolist()
        out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
        w = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        while open_:
            left = sum(sizes) * 1.5 - sum(out[i] for i in range(len(sizes)) if i not in open_)
            share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
            over = [i for i in open_ if share[i] > 2 * sizes[i]]
            for i in over or open_:
                out[i] = 2.0 * sizes[i] if over else share[i]
            open_ -= set(over or open_)
        assert mixing.targets(sizes) == pytest.approx(out)


def test_fit_is_exact_where_sums_reach():
    sizes, counts = np.array([3, 7, 11]), np.array([5, 4, 2])
    reach = {3 * a + 7 * b + 11 * c for a in range(6) for b in range(5) for c in range(3)}
    for budget in range(0, 70):
        k = mixing.fit(sizes, counts, budget)
        assert (k <= counts).all() and (k >= 0).all()
        got = int((k * sizes).sum())
        # a share of every size comes first, so a sum just below can stand where an exact one exists
        assert got <= budget and (budget - got <= 3 or got == max(s for s in reach if s <= budget))


def test_mix(frame, docs):
    out = mixing.mix(frame).collect()
    assert len(out) == len(docs) and {r["size"] for r in out} >= {0}
    sums = {}
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"])
        s = sums.setdefault(r.source, [0, r.target, r.source_size, []])
        s[0] += r.taken
        s[3].append(r["size"])
    for taken, target, size, sizes in sums.values():
        assert size == sum(sizes)
        budget, reach = int(round(target)), {0}
        for x in sizes:  # every document again beyond full rounds
            reach |= {y + x for y in reach if y + x <= budget - int(target // size) * size}
        assert taken == int(target // size) * size + max(reach)
    again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    copies = mixing.mixed(frame)
    assert copies.columns == frame.columns and copies.count() == sum(r.taken // r["size"] for r in out if r["size"])


def test_mix_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
