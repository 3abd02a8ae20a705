"""Leading blocks of ``key: value`` lines in four dialects, as column expressions.

A dialect gives struct<error, fields: array<struct<name, kind, value, items, raw>>>: the error class (null if there is
none), and the fields in order. Lines are told apart first (blank, comment, nested, pair, bad); nested lines belong to the pair above them. Values are typed
where the dialect types them: null, bool, int, float, text, list (its items typed alike), nested (kept raw).

=========  ==============================  ======================  =================================================
dialect    block                           a key twice             else
=========  ==============================  ======================  =================================================
pattern    up to the next ``---`` line     the last wins           values are text, one expression finds all
flat       closed by a ``---`` line        the first wins          nested lines, comments and list items are left out
strict     closed, or error ``unclosed``   the last wins           errors ``not_a_mapping``, ``bad_line``, ``tab_indent``
capture    closed by ``---`` at a start    the last wins           errors ``no_front_matter``, ``unclosed``, ``bad_line``;
           of a line, or ``unclosed``                              fields that are not known keep their raw lines
=========  ==============================  ======================  =================================================

A text without a block has no fields (no error but in capture); a null text gives null. Nested values are not parsed further.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = "struct<name:string,kind:string,value:string,items:array<struct<kind:string,value:string>>,raw:string>"
# What a field looks like in the pattern dialect, and where its block ends.
PATTERN = r"(?md)^([A-Za-z_][A-Za-z0-9_-]*):\s*(.*?)\s*$"
PATTERN_BLOCK = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
_QUOTED = r'(?s)^"([^"\\]|\\.)*"\z'


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _result(error: Column, fields: Column) -> Column:
    return F.struct(error.cast("string").alias("error"), F.when(error.isNull(), fields).otherwise(F.array().cast(f"array<{FIELD}>")).alias("fields"))


def _field(name: Column, typed: Column, raw: Column) -> Column:
    return F.struct(name.alias("name"), typed["kind"].alias("kind"), typed["value"].alias("value"), typed["items"].alias("items"), raw.alias("raw"))


def _typed(kind: str, value: Column, items: Column | None = None) -> Column:
    none = F.lit(None).cast("array<struct<kind:string,value:string>>")
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (none if items is None else items).alias("items"))


def _unquoted(v: Column) -> Column:
    """A JSON string; null if it is none."""
    return F.when(v.rlike(_QUOTED), F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"])


def _inner(v: Column) -> Column:
    return v.substr(F.lit(2), F.length(v) - 2)


def _integer(v: Column) -> Column:
    """Plain digits of a whole number: no plus sign, underscores or leading zeros."""
    digits = F.regexp_replace(F.replace(v, F.lit("_"), F.lit("")), r"^([+-]?)0+(?=\d)", "$1")
    return F.when(digits.rlike(r"^[+-]?0\z"), "0").otherwise(F.regexp_replace(digits, r"^\+", ""))


_INT = r"^[+-]?\d+(_\d+)*\z"


def flat_scalar(c: Column) -> Column:
    """text or null: quotes taken off, nothing else typed."""
    def one(v: Column) -> Column:
        text = F.when(v.startswith('"'), F.coalesce(_unquoted(v), F.btrim(v, F.lit('"')))).when((F.length(v) >= 2) & v.startswith("'") & v.endswith("'"), F.replace(_inner(v), F.lit("''"), F.lit("'"))).otherwise(v)
        return F.when(v.isin("null", "~"), _typed("null", F.lit(None))).otherwise(_typed("text", text))

    return _let(F.btrim(c, F.lit(" \t\r\x0b\x0c")), one)


def _plain_scalar(v: Column) -> Column:
    """A scalar of the capture dialect that is no list."""
    text = F.when(v.startswith('"'), F.coalesce(_unquoted(v), _inner(v))).otherwise(_inner(v))
    quoted = (F.length(v) >= 2) & ((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'")))
    return F.when(v.isin("null", "~"), _typed("null", F.lit(None))).when(v.isin("true", "false"), _typed("bool", v)).when(quoted, _typed("text", text)).when(v.rlike(_INT), _typed("int", _integer(v))).otherwise(_typed("text", v))


def capture_scalar(c: Column) -> Column:
    def one(v: Column) -> Column:
        inner = F.trim(_inner(v))
        items = F.when(inner == "", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(
            F.transform(F.split(inner, ","), lambda x: _let(_plain_scalar(F.trim(x)), lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"))))
        )
        return F.when((F.length(v) >= 2) & v.startswith("[") & v.endswith("]"), _typed("list", inner, items)).otherwise(_plain_scalar(v))

    return _let(F.btrim(c, F.lit(" \t\r\x0b\x0c")), one)


def strict_scalar(c: Column) -> Column:
    """Scalars of YAML 1.1 that stand on one line."""
    def plain(v: Column) -> Column:
        double = F.coalesce(_unquoted(v), _inner(v))
        return (
            F.when(v.isin("", "~", "null", "Null", "NULL"), _typed("null", F.lit(None)))
            .when(v.rlike(r"^(true|True|TRUE|yes|Yes|YES|on|On|ON)\z"), _typed("bool", F.lit("true"))).when(v.rlike(r"^(false|False|FALSE|no|No|NO|off|Off|OFF)\z"), _typed("bool", F.lit("false")))
            .when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), _typed("text", double)).when((F.length(v) >= 2) & v.startswith("'") & v.endswith("'"), _typed("text", F.replace(_inner(v), F.lit("''"), F.lit("'"))))
            .when(v.rlike(r"^[+-]?(0|[1-9][\d_]*)\z"), _typed("int", _integer(v))).when(v.rlike(r"^[+-]?(\d[\d_]*)?\.\d*([eE][+-]\d+)?\z") & v.rlike(r"\d"), _typed("float", v)).otherwise(_typed("text", v))
        )

    def one(v: Column) -> Column:
        bare = F.when(v.rlike("^[\"'\\[]"), v).otherwise(F.trim(F.regexp_replace(v, r"(^|\s)#.*$", "")))
        inner = F.trim(_inner(bare))
        items = F.when(inner == "", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(
            F.transform(F.split(inner, ","), lambda x: _let(plain(F.trim(x)), lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"))))
        )
        return F.when((F.length(bare) >= 2) & bare.startswith("[") & bare.endswith("]"), _typed("list", inner, items)).otherwise(plain(bare))

    return _let(F.btrim(c, F.lit(" \t\r\x0b\x0c")), one)


def _first_wins(fields: Column) -> Column:
    return F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, F.lit(1), i), lambda g: g["name"] == f["name"]))


def _last_wins(fields: Column) -> Column:
    return F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)), lambda g: g["name"] == f["name"]))


def pattern(text: Column) -> Column:
    block = F.regexp_extract(text, PATTERN_BLOCK, 1)
    pairs = F.zip_with(F.regexp_extract_all(block, F.lit(PATTERN), 1), F.regexp_extract_all(block, F.lit(PATTERN), 2), lambda k, v: _field(k, _typed("text", v), v))
    return F.when(text.isNotNull(), _let(pairs, lambda f: _result(F.lit(None), _last_wins(f))))


def flat(text: Column, partial: bool = False) -> Column:
    """``partial``: an open block counts up to the end of the text."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r+\z", ""))

    def parsed(ls: Column) -> Column:
        rest = F.slice(ls, 2, F.size(ls))
        end = F.array_position(rest, "---")
        inside = F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).when(F.lit(partial), rest).otherwise(F.array().cast("array<string>"))
        pairs = F.filter(inside, lambda x: ~x.rlike(r"^([ \t#-]|\z)") & x.contains(":"))
        fields = F.transform(pairs, lambda x: _field(F.trim(F.substring_index(x, ":", 1)), flat_scalar(x.substr(F.locate(":", x) + 1, F.length(x))), x))
        return F.when(ls[0] == "---", _let(fields, lambda f: _result(F.lit(None), _first_wins(f)))).otherwise(_result(F.lit(None), F.array().cast(f"array<{FIELD}>")))

    return F.when(text.isNotNull(), _let(lines, parsed))


def _line(x: Column) -> Column:
    """kind of a line: blank, comment, nested, pair, bad."""
    return (
        F.when(x.rlike(r"^\s*\z"), "blank").when(x.rlike(r"^\s+#"), "inner_comment").when(x.startswith("#"), "comment").when(x.rlike("^([ \t]|- )"), "nested").when(x.contains(":"), "pair").otherwise("bad")
    )


def _entries(block: Column, scalar: Callable[[Column], Column], keep_comments: bool, pair: str, known: tuple[str, ...] | None) -> Column:
    """(fields, kinds of lines): every pair with the nested lines below it."""
    lines = F.split(block, "\n", -1)

    def parsed(ls: Column) -> Column:
        kinds = F.transform(ls, lambda x: F.when((_line(x) == "pair") & ~x.rlike(pair), "bad").otherwise(_line(x)))

        def fields(ks: Column) -> Column:
            at = F.filter(F.transform(ks, lambda k, i: F.when(k == "pair", i)), lambda i: i.isNotNull())

            def field(i: Column, n: Column) -> Column:
                end = F.when(n + 1 < F.size(at), F.element_at(at, (n + 2).cast("int"))).otherwise(F.size(ls))
                below = F.filter(F.sequence(i, F.greatest(end - 1, i)), lambda j: (j > i) & (ks[j].isin("nested", "inner_comment") if keep_comments else (ks[j] == "nested")))
                line = ls[i]
                name = F.trim(F.substring_index(line, ":", 1))
                raw = F.array_join(F.concat(F.array(line), F.transform(below, lambda j: ls[j])), "\n")
                value = line.substr(F.locate(":", line) + 1, F.length(line))
                plain = F.size(below) == 0
                if known is not None:
                    return F.when(plain & name.isin(*known), _field(name, scalar(value), raw)).otherwise(_field(name, _typed("raw", F.btrim(raw.substr(F.locate(":", raw) + 1, F.length(raw)), F.lit(" \t\n\r\x0b\x0c"))), raw))
                return F.when(plain, _field(name, scalar(value), raw)).otherwise(_field(name, _typed("nested", F.array_join(F.transform(below, lambda j: ls[j]), "\n")), raw))

            return F.struct(F.transform(at, field).alias("fields"), ks.alias("kinds"), ls.alias("lines"))

        return _let(kinds, fields)

    return _let(lines, parsed)


def _first_of(kinds: Column) -> Column:
    return F.get(F.filter(kinds, lambda k: ~k.isin("blank", "comment", "inner_comment")), F.lit(0))


def strict(text: Column) -> Column:
    close = F.locate("\n---\n", text, 5)
    block = text.substr(F.lit(5), F.greatest(close - 5, F.lit(0)))

    def parsed(e: Column) -> Column:
        error = (
            F.when(F.exists(e["lines"], lambda x: x.rlike("^ *\t")), "tab_indent").when(_first_of(e["kinds"]).isin("bad", "nested"), "not_a_mapping").when(F.array_contains(e["kinds"], "bad"), "bad_line")
        )
        return _result(error, _last_wins(e["fields"]))

    none = _result(F.lit(None), F.array().cast(f"array<{FIELD}>"))
    return F.when(text.isNull(), None).when(~text.startswith("---\n"), none).when(close == 0, _result(F.lit("unclosed"), F.array().cast(f"array<{FIELD}>"))).otherwise(_let(_entries(block, strict_scalar, False, r":(\s|\z)", None), parsed))


def capture_close(text: Column) -> Column:
    """Where the line that ends a capture's block begins (1-based place of the line feed before it), 0 without one."""
    return F.when(F.locate("\n---\n", text, 4) > 0, F.locate("\n---\n", text, 4)).otherwise(F.locate("\n---", text, 4))


def capture(text: Column, known: tuple[str, ...]) -> Column:
    close = capture_close(text)
    block = text.substr(F.lit(5), F.greatest(close - 5, F.lit(0)))

    def parsed(e: Column) -> Column:
        error = F.when(F.array_contains(e["kinds"], "bad") | (_first_of(e["kinds"]) == "nested"), "bad_line")
        return _result(error, _last_wins(e["fields"]))

    none = F.array().cast(f"array<{FIELD}>")
    return F.when(text.isNull(), None).when(~text.startswith("---\n"), _result(F.lit("no_front_matter"), none)).when(close == 0, _result(F.lit("unclosed"), none)).otherwise(_let(_entries(block, capture_scalar, True, ":", known), parsed))
