"""Front matter and sections of records, case by case and against plain line loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import front_matter as M
from textloom.operators import sections as S


def parse(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(2)
    return [r.p for r in sorted(df.select("id", f(F.col("text")).alias("p")).collect(), key=lambda r: r.id)]


def plain(p):
    return None if p is None else (p.error, [(f.name, f.kind, f.value) for f in p.fields])


def test_flat_dialect(spark):
    texts = [None, "", "no block", "---\na: 1\n---\nb: 2", "---\na: 1\nb: 2", "---\r\na: x \r\n---\r\n", '---\na: "q \\u00e9"\nb: "bad\nc: \'it\'\'s\'\nd: ~\na: again\n  nested: 1\n# c: 2\n- e: 3\nplain\nf:g:h\n---', '---\na: "x", "y"\n---']
    got = [plain(p) for p in parse(spark, texts, M.flat)]
    assert got[0] is None and got[1:3] == [(None, [])] * 2
    assert got[3] == (None, [("a", "text", "1")]) and got[4] == (None, []) and got[5] == (None, [("a", "text", "x")])
    assert got[6] == (None, [("a", "text", "q é"), ("b", "text", "bad"), ("c", "text", "it's"), ("d", "null", None), ("f", "text", "g:h")])
    assert got[7] == (None, [("a", "text", 'x", "y')])
    assert plain(parse(spark, ["---\na: 1\nb: 2"], lambda c: M.flat(c, partial=True))[0]) == (None, [("a", "text", "1"), ("b", "text", "2")])


def test_pattern_dialect(spark):
    texts = ["---\na: 1\n-x: 2\nb-c:  v  \na: 3\n---\nd: 4\n", "---\na: 1\n", "x\n---\na: 1\n---\n", "---\r\na: 1\r\n---\r\n", "---\na:\nb: 1\nc: 2\n---\n"]
    got = [plain(p) for p in parse(spark, texts, M.pattern)]
    want = []
    for t in texts:
        m = re.match(r"\A---\r?\n(.*?)\r?\n---\r?\n", t, re.DOTALL)
        want.append((None, [(k, "text", v) for k, v in dict(re.findall(r"^([A-Za-z_][A-Za-z0-9_-]*):\s*(.*?)\s*$", m[1], re.MULTILINE)).items()] if m else []))
    assert [(e, sorted(f)) for e, f in got] == [(e, sorted(f)) for e, f in want]


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ("a: 1\nb: -007\nc: 1.5\nd: yes\ne: 'it''s'\nf: \"t\\n\"\ng: [1, x, \"y\"]\nh:\ni: v # note", ["int 1", "text -007", "float 1.5", "bool true", "text it's", "text t\n", 'list 1, x, "y"', "null None", "text v"]),
        ("a:\n  b: 1\n  - c\nd: 2", ["nested   b: 1\n  - c", "int 2"]), ("a: 1\na: 2", ["int 2"]), ("# only\n\n", []), ("- a\n- b", "not_a_mapping"), ("plain", "not_a_mapping"), ("a:b", "not_a_mapping"), ("a: 1\nplain", "bad_line"), ("a:\n\tb: 1", "tab_indent"),
    ],
)
def test_strict_dialect(spark, block, want):
    p = parse(spark, [f"---\n{block}\n---\nbody"], M.strict)[0]
    assert (p.error or [f"{f.kind} {f.value}" for f in p.fields]) == want
    if want and "list" in str(want):
        assert [(i.kind, i.value) for i in p.fields[6]["items"]] == [("int", "1"), ("text", "x"), ("text", "y")]


def test_strict_dialect_blocks(spark):
    assert [plain(p) for p in parse(spark, ["none", "---\na: 1", "---\n---\n", "---\n\n---\n", None], M.strict)] == [(None, []), ("unclosed", []), ("unclosed", []), (None, []), None]


def test_capture_dialect(spark):
    known = ("id", "n", "flags", "ok")
    text = '---\nid: cap-1\nn: 1_0\nflags: [a, 2, "x"]\nok: true\n\n# note\nnew: {a: 1}\ndeep:\n  a: 1\n  # inside\n- b\nid: cap-2\n---\nbody'
    p = parse(spark, [text], lambda c: M.capture(c, known))[0]
    assert p.error is None and [(f.name, f.kind, f.value) for f in p.fields] == [("n", "int", "10"), ("flags", "list", 'a, 2, "x"'), ("ok", "bool", "true"), ("new", "raw", "{a: 1}"), ("deep", "raw", "a: 1\n  # inside\n- b"), ("id", "text", "cap-2")]
    assert p.fields[4].raw == "deep:\n  a: 1\n  # inside\n- b" and [i.value for i in p.fields[1]["items"]] == ["a", "2", "x"]
    errors = [p and p.error for p in parse(spark, ["x", "---\nid: 1", "---\nbad\n---\n", "---\n  a: 1\n---\n", "---\nid: 1\n--- tail", "---\n---\n", None], lambda c: M.capture(c, known))]
    assert errors == ["no_front_matter", "unclosed", "bad_line", "bad_line", None, None, None]


def by_lines(text, escaped):
    """(sections, ambiguous) of a record's body, line by line."""
    at = text.find("\n---\n", 3)
    names, found, order, now = S.SECTIONS + S.OPTIONAL, {}, [], None
    for line in re.findall(r"[^\n]*\n|[^\n]+", text[at + 4 :]):
        m = re.fullmatch(r"## (.+?)\n" if escaped else r"## (.+?)[ \t]*\n?", line)
        if m and m[1] in names:
            now = m[1]
            order.append(now)
            found[now] = ""
        elif now is not None:
            found[now] += line
    notes = [f"twice: {n}" for n in dict.fromkeys(order) if order.count(n) > 1] + ["out of order"] * (order != [n for n in names if n in order])
    for n, v in found.items():
        v = v.removeprefix("\n")
        v = v[:-1] if v.endswith("\n\n") else v
        found[n] = re.sub(r"(?m)^\\(\\*##)", r"\1", v) if escaped else v
    return found, notes


def test_sections_of_random_records(spark):
    r = random.Random(9)
    heads = [f"## {n}" for n in S.SECTIONS[:3] + S.OPTIONAL] + ["## Other", "##Review notes", "## Review notes  ", "\\## Review notes", "\\\\## x", "## User-supplied text\r"]
    texts, flags = [], []
    for _ in range(300):
        escaped = r.random() < 0.5
        body = "\n".join(r.choice([*heads, "", "text", "a b", "\r"]) for _ in range(r.randint(0, 14))) + r.choice(["", "\n", "\n\n"])
        texts.append("---\nid: cap-1\n" + (f"body_encoding: {S.ESCAPED}\n" if escaped else "") + "---\n" + body)
        flags.append(escaped)
    for t, escaped, p in zip(texts, flags, parse(spark, texts, S.parse)):
        found, notes = by_lines(t, escaped)
        assert p.error is None and {s.name: s.content for s in p.sections} == found and list(p.ambiguous) == notes, t


def test_errors_of_records(spark):
    texts = [None, "", "---\nid: 1\n", "---\nid\n---\n## Review notes\n", "---\nbody_encoding: v9\n---\n## Review notes\n", "---\nid: 1\n---"]
    got = [p and (p.error, len(p.sections)) for p in parse(spark, texts, S.parse)]
    assert got == [None, ("no_front_matter", 0), ("unclosed", 0), ("bad_line", 0), ("unknown_encoding", 0), (None, 0)]


def test_records_come_back_as_written(spark):
    r = random.Random(10)
    bits = ["## Review notes", "plain", "\\## Machine description", "", "## x", "é\r", "\\\\## y"]
    rows = []
    for i in range(60):
        own = {n: "".join(r.choice(bits) + "\n" for _ in range(r.randint(0, 5))) for n in S.SECTIONS + S.OPTIONAL}
        rows.append((i, [("id", f"cap-{i}"), ("title", json.dumps("a: b"))], [(n, c) for n, c in own.items()]))
    df = spark.createDataFrame(rows, "i long, f array<struct<name:string,value:string>>, s array<struct<name:string,content:string>>")
    out = df.select("i", S.parse(S.render(F.col("f"), F.col("s"))).alias("p")).collect()
    for x in out:
        own = dict(rows[x.i][2])
        want = {n: c for n, c in own.items() if n in S.SECTIONS or c.strip()}
        got = {s.name: s.content for s in x.p.sections}
        assert x.p.error is None and not x.p.ambiguous and set(got) == set(want)
        for n, c in want.items():  # an empty section is a bare line; one that begins with a line feed loses none
            assert got[n] == c or (c == "" and got[n] in ("", "\n"))
        assert [f.value for f in x.p.fields][:2] == [f"cap-{x.i}", "a: b"]


def test_fields_as_a_table(spark):
    df = spark.createDataFrame([(1, "---\na: 1\nb: x\n---\n"), (2, "none"), (3, None), (4, "---\nbad\n---\n")], "id long, text string")
    got = {tuple(r) for r in S.field_rows(df, "id", M.strict(F.col("text"))).collect()}
    assert got == {(1, None, 1, "a", "int", "1", "a: 1"), (1, None, 2, "b", "text", "x", "b: x"), (2, None, None, None, None, None, None), (3, None, None, None, None, None, None), (4, "not_a_mapping", None, None, None, None, None)}
