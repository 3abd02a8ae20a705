"""Position-mapped forms and hits against a walk over each character."""

import random
import unicodedata

import pytest

from textloom.functions import mapped
from textloom.operators import positions as P

SOME = "aAbB \t\n ß ﬁ ﷺ İ ½ كيىېة ۱٢3 ‌‍ ـ ًۖ é é 𝒜 \U0001f600 -"


def plain(text):
    """(form, places), one character after another."""
    like = dict(zip("كيىېة۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "کیییه01234567890123456789"))
    form, at = [], []
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFKC", ch):
            if c in "‌‍‎‏ـٰ" or 0x064B <= ord(c) < 0x0660 or 0x06D6 <= ord(c) < 0x06EE:
                continue
            for x in " " if c.isspace() else like.get(c, c).casefold():
                if x != " " or (form and form[-1] != " "):
                    form.append(x)
                    at.append(i)
    return "".join(form), at


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    return ["", " ", "‌", "ـ a", *["".join(r.choice(SOME) for _ in range(r.randint(1, 120))) for _ in range(300)]]


def test_forms_of_a_batch(texts):
    f = mapped.forms(texts)
    for d, t in enumerate(texts):
        assert (f.text(d), f.at[f.first[d] : f.first[d + 1]].tolist()) == plain(t)
    assert mapped.forms([]).first.tolist() == [0]


def by_hand(text, needle, fold):
    form, at = plain(text) if fold else (text, list(range(len(text))))
    n = plain(needle.strip())[0] if fold else needle.strip()
    starts, ends, k = [], [], 0
    while k + len(n) <= len(form):
        if form[k : k + len(n)] == n:
            starts.append(at[k])
            ends.append(at[k + len(n) - 1] + 1)
            k += len(n)
        else:
            k += 1
    return starts, ends


@pytest.mark.parametrize("fold", [True, False])
def test_hits_are_places_of_the_source(spark, texts, fold):
    needles = ["A b", "aa", "ss", "fi", "ی", "12", "é", " b ", "😀"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "x a‌b\n\nA \t B y"), (9001, "x a‌b\n\nA \t B y")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {}
    for r in P.find(df, "id", "text", needles, fold).collect():
        got.setdefault((r.id, r.needle), []).append(r)
    want = {(i, n): by_hand(t or "", n, fold) for i, t in rows for n in needles}
    assert set(got) == {k for k, v in want.items() if v[0]}
    for (i, n), found in got.items():
        assert len(found) == (2 if i == 9001 else 1)
        r, text = found[0], dict(rows)[i]
        assert (r.starts, r.ends) == want[i, n] and r.hit_count == len(r.starts)
        lines = list(dict.fromkeys(text.count("\n", 0, s) + 1 for s in r.starts))
        assert (r.line, r.lines) == (lines[0], lines[:3])
        assert r.context == text[max(0, r.starts[0] - 80) : r.starts[0] + len(n.strip()) + 120].replace("\n", " ")


def test_map_of_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    got = {r.id: (r.form, r["at"]) for r in P.source_map(df, "id", "text").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} | {-1: (None, None)}
    assert P.source_map(df.limit(0), "id", "text").count() == 0 and P.find(df.limit(0), "id", "text", ["a"]).count() == 0


def test_empty_needle_is_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    for needle in ("", "  ", "‌", "ـ"):
        with pytest.raises(ValueError):
            P.find(df, "id", "text", ["a", needle])
