"""Line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses too much of its text is rejected. All work is done inside a row: no
shuffle, so any skew of sources or keys is harmless.

Nulls, empty and blank texts have no words and fail the base rule; a text that loses exactly the most it may
is kept; repeated rows get equal rows; an empty table gives an empty result; extra input columns are ignored by
``judge`` and kept by ``clean``, whatever their names. A very long text or line is worked in its row: memory and n log n time follow its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import quoted

#: Separators between words, symbols, phrases of lines that carry no content.
SPACE = r"[ \t-\r]+"
SYMBOLS = "[^#*$%&|<>]+"
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "subscribe to our", "copyright (c)", "skip to content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "zum inhalt springen", "conditions d'utilisation", "politique de confidentialit",
    "aller au contenu", "todos los derechos reservados", "condiciones de uso", "aviso legal", "ir al contenido",
)
#: Marks between the entries of a menu; what ends a sentence or part of one; ends of teasers.
SEPARATORS = "|›•·"
TITLE = """^[ \t-\r]*([^ \t-\r]+[ \t]+){0,2}[^ \t-\r]*[^ \t-\r.!?:;,"'”»)\\]…][ \t-\r]*\\z"""
CUT_SHORT = ("...", "…")


_PHRASES = "(?i)" + "|".join(re.escape(p) for p in BOILERPLATE)


@dataclass(frozen=True)
class LineRules:
    """Thresholds, in percent unless they say otherwise."""

    min_words: int = 50
    max_repeat: int = 50
    max_symbols: int = 30
    max_separators: int = 20
    max_links: int = 30
    max_exclaimed: int = 50
    max_lost: int = 50


def _count(text: Column, *marks: str) -> Column:
    """Occurrences of marks of one length, without a regular expression."""
    bare = text
    for m in marks:
        bare = F.replace(bare, F.lit(m), F.lit(""))
    return (F.length(text) - F.length(bare)) / len(marks[0])


def line_fails(line: Column, rules: LineRules) -> Column:
    """Punctuation, navigation and boilerplate rules of one line; a blank line passes.

    Punctuation: symbols, repeated exclamation marks, a teaser's end, three words or fewer without any end mark.
    Navigation: menu separators, lists of links. Words are counted by their separators (spaces and tabs). One search
    decides whether a line has anything to count. (A test of the whole text outside the lambda would be inlined into it.)"""
    words = _count(line, " ", "\t") + 1
    bars, links = _count(line, *SEPARATORS), _count(line, "://")
    return (line.rlike(f"[#*$%&<>{SEPARATORS}]|!!|://") & (
        (_count(line, *"#*$%&<>") * 100 > words * rules.max_symbols)
        | ((bars * 100 > words * rules.max_separators) & (bars >= 2))
        | ((links * 100 > words * rules.max_links) & (links >= 2))
        | (_count(line, "!!") * 100 > words * rules.max_exclaimed)
    )) | line.endswith(CUT_SHORT[0]) | line.endswith(CUT_SHORT[1]) | line.rlike(TITLE) | line.rlike(_PHRASES)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``_w``: words in 3-word windows that occur twice or more.

    Windows are sorted by hash and position; neighbours of one hash are compared word by word, so cost is
    n log n in the row.
    """
    df = df.withColumn("_h", F.expr("if(_n < 4, cast(array() as array<bigint>), transform(sequence(0, _n - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    df = df.withColumn("_v", F.expr("sort_array(transform(_h, (h, i) -> struct(h, i)))"))
    same = "({o}.h = x.h and _w[{o}.i] = _w[x.i] and _w[{o}.i + 1] = _w[x.i + 1] and _w[{o}.i + 2] = _w[x.i + 2])"
    df = df.withColumn("_q", F.expr(f"sort_array(transform(filter(_v, (x, k) -> (k > 0 and {same.format(o='_v[greatest(k - 1, 0)]')}) or (k < _n - 3 and {same.format(o='_v[least(k + 1, _n - 3)]')})), x -> x.i))"))
    return df.withColumn("n_repeat_words", F.expr("if(size(_q) = 0, 0L, 3L + aggregate(sequence(1, greatest(size(_q) - 1, 1)), 0L, (a, k) -> a + if(k < size(_q), least(3, _q[least(k, size(_q) - 1)] - _q[k - 1]), 0)))"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_removed,
    chars_lost, kept (and with ``carry`` _c: a struct of all columns but the text, by place, and _clean: the text without failing lines; null stays null)."""
    rest = F.struct(F.lit(0).alias("c"), *[docs[quoted(c)].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    df = docs.select(docs[quoted(id_col)].alias("_id"), docs[quoted(text_col)].alias("_text"), *([rest.alias("_c")] if carry else []))
    text = F.coalesce("_text", F.lit(""))
    df = df.withColumn("_t", text).withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("_lines", F.split("_t", "\n"))
    df = df.withColumn("_n", F.size("_w"))
    df = _repeat_words(df)
    bare = F.col("_t")
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    full = F.filter("_lines", lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.withColumns({"_full": full, "_bad": F.filter("_lines", lambda x: line_fails(x, rules)), "_chars": F.length(bare)})
    df = df.withColumn("chars_lost", F.expr("aggregate(_bad, 0L, (a, x) -> a + length(x))"))
    failed = (F.col("_n") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("_n").cast("long") * rules.max_repeat)
    return df.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        # always true, but not deterministic: a later filter on kept stays above the projections, which
        # pushing it down would copy into the filter many times over
        (~failed & (F.col("chars_lost") * 100 <= F.length("_t").cast("long") * rules.max_lost) & (F.monotonically_increasing_id() >= 0)).alias("kept"),
        F.size("_bad").cast("long").alias("lines_removed"),
        "chars_lost",
        *(["_c", F.when(F.col("_text").isNotNull(), F.array_join(F.filter("_lines", lambda x: ~line_fails(x, rules)), "\n")).alias("_clean")] if carry else []),
    )


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", size_col: str | None = "n_chars", id_col: str = "doc_id") -> DataFrame:
    """The kept documents without their failing lines, with the input's columns; size_col is counted anew."""
    names = docs.columns
    df = judge(docs, id_col, text_col, rules, carry=True).where("kept")
    out = {n: F.col("_clean") if n == text_col else F.col(f"_c.c{k}") for k, n in enumerate(names)}
    if size_col in out:
        out[size_col] = F.length("_clean").cast(docs.schema[size_col].dataType)
    return df.select(*[c.alias(n) for n, c in out.items()])
