"""Records of a front-matter block and named sections: parsed, judged, written.

Lines end at line feeds alone. A header line opens a section, all up to the next header is its content; what stands before the first header is dropped.
A record whose field ``body_encoding`` names the escaped form takes only lines that are exactly ``## name`` as headers, and its
content lines with escaped headings lose one backslash. Everything is column expressions inside a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import front_matter as M
from .records import escape_headings, unescape_headings

# Sections in their order (the last only where it holds text), the escaped form, fields in their order.
SECTIONS = ("User-supplied text", "Literal transcript or extraction", "Machine description", "Review notes", "Provenance events")
OPTIONAL = ("Interpretation (candidate)",)
ENCODING, ESCAPED = "body_encoding", "escaped-headings-v1"
FIELDS = (
    "id", "type", "title", "status", "capture_kind", "captured_at", "capture_channel", "language_hint", "raw_media", "raw_media_available", "sha256", "bytes", "duplicate_of", "transcription_state",
    "transcription_method", "transcription_version", "transcription_reviewed", "quality_flags", "promoted_to", "schema_version", "interpretation_needs", "derivative_methods", "derivative_tier",
)
_NAMED = "array<struct<name:string,content:string>>"


def parse(text: Column, names: tuple[str, ...] = SECTIONS + OPTIONAL, known: tuple[str, ...] = FIELDS) -> Column:
    """struct<error, fields, sections (name, content; in order of first header), ambiguous>.

    error: no_front_matter, unclosed, bad_line, unknown_encoding. A section that comes twice keeps its last content; ``ambiguous`` says which do, and whether
    the headers are out of order. One blank line after a header and one before the next are not content. Null text gives null."""
    return F.when(text.isNotNull(), M._let(M.capture(text, known), lambda head: _parsed(text, head, names)))


def _parsed(text: Column, head: Column, names: tuple[str, ...]) -> Column:
    encoding = F.get(F.filter(head["fields"], lambda f: f["name"] == ENCODING), F.lit(0))["value"]
    escaped = F.coalesce(encoding == ESCAPED, F.lit(False))
    error = F.when(head["error"].isNotNull(), head["error"]).when(encoding.isNotNull() & (encoding != ESCAPED), "unknown_encoding")
    body = text.substr(M.capture_close(text) + 4, F.length(text))
    lines = F.split(body, "\n", -1)

    def sections(ls: Column) -> Column:
        last = F.size(ls) - 1  # what follows the last line feed; no line if it is empty
        loose = lambda x: F.regexp_extract(x, r"(?s)^## (.+?)[ \t]*\z", 1)
        strict = lambda x, i: F.when(x.startswith("## ") & (i < last), x.substr(F.lit(4), F.length(x))).otherwise("")
        heads = F.filter(F.transform(ls, lambda x, i: F.struct(F.when(escaped, strict(x, i)).otherwise(loose(x)).alias("name"), i.alias("at"))), lambda h: h["name"].isin(*names))

        def contents(hs: Column) -> Column:
            def one(h: Column, k: Column) -> Column:
                end = F.when(k + 1 < F.size(hs), F.element_at(hs, (k + 2).cast("int"))["at"]).otherwise(F.when(ls[last] == "", last).otherwise(last + 1))
                own = F.slice(ls, h["at"] + 2, F.greatest(end - h["at"] - 1, F.lit(0)))
                ends = F.when((end > last) & (ls[last] != ""), "").otherwise(F.when(F.size(own) > 0, "\n").otherwise(""))
                return F.struct(h["name"].alias("name"), _trimmed(F.concat(F.array_join(own, "\n"), ends), escaped).alias("content"))

            every = F.transform(hs, one)
            order = F.transform(hs, lambda h: h["name"])
            firsts = F.array_distinct(order)
            kept = F.transform(firsts, lambda n: F.element_at(F.filter(every, lambda e: e["name"] == n), -1))
            twice = F.filter(firsts, lambda n: F.size(F.filter(order, lambda o: o == n)) > 1)
            canonical = F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(order, n))
            notes = F.concat(F.transform(twice, lambda n: F.concat(F.lit("twice: "), n)), F.when(order != canonical, F.array(F.lit("out of order"))).otherwise(F.array().cast("array<string>")))
            return F.struct(kept.alias("sections"), notes.alias("ambiguous"))

        return M._let(heads, contents)

    def whole(s: Column) -> Column:
        return F.struct(
            error.alias("error"), F.when(error.isNull(), head["fields"]).otherwise(F.array().cast(f"array<{M.FIELD}>")).alias("fields"),
            F.when(error.isNull(), s["sections"]).otherwise(F.array().cast(_NAMED)).alias("sections"), F.when(error.isNull(), s["ambiguous"]).otherwise(F.array().cast("array<string>")).alias("ambiguous"),
        )

    return M._let(M._let(lines, sections), whole)


def _trimmed(content: Column, escaped: Column) -> Column:
    def cut(c: Column) -> Column:
        led = F.when(c.startswith("\n"), c.substr(F.lit(2), F.length(c))).otherwise(c)
        return M._let(led, lambda x: F.when(x.endswith("\n\n"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))

    return M._let(M._let(content, cut), lambda x: F.when(escaped, unescape_headings(x)).otherwise(x))


def render(fields: Column, sections: Column, names: tuple[str, ...] = SECTIONS, optional: tuple[str, ...] = OPTIONAL) -> Column:
    """The record's text: ``name: value`` lines (fields: array of name, value), then the sections (array of name, content) in their order.

    Content with lines that look like headings is escaped, and a field says so. Optional sections are left out when blank."""
    content = lambda n: F.coalesce(F.get(F.filter(sections, lambda s: s["name"] == n), F.lit(0))["content"], F.lit(""))
    every = [content(n) for n in names + optional]
    escape = F.lit(False)
    for c in every:
        escape = escape | c.rlike(r"(?m)^\\*##")
    shown = lambda c: F.when(escape, escape_headings(c)).otherwise(c)
    part = lambda n, c: F.concat(F.lit(f"## {n}\n\n"), M._let(shown(c), lambda x: F.when((x == "") | x.endswith("\n"), x).otherwise(F.concat(x, F.lit("\n")))), F.lit("\n"))
    parts = [part(n, c) if n in names else F.when(c.rlike(r"\S"), part(n, c)).otherwise(F.lit("")) for n, c in zip(names + optional, every)]
    head = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["value"])), "\n")
    head = F.concat(head, F.when(escape, F.lit(f"\n{ENCODING}: {ESCAPED}")).otherwise(F.lit("")))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), *parts)


def field_rows(rows: DataFrame, key: str, parsed: Column) -> DataFrame:
    """key, error, place, name, kind, value, raw: the fields of a dialect as a table; a row of its own says that a text has none."""
    df = rows.select(rows[f"`{key}`"].alias("_key"), parsed.alias("p"))
    df = df.select("_key", F.col("p.error").alias("error"), F.posexplode_outer("p.fields").alias("place", "f"))
    return df.select(F.col("_key").alias(key), "error", (F.col("place") + 1).cast("long").alias("place"), "f.name", "f.kind", "f.value", "f.raw")
