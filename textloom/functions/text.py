"""Text functions: normal forms, tokens, query clean-up, positions, estimates. Columns in, columns out.

The SQL form of the normal form holds for text that NFKC leaves as it is; ``normal_form`` is the full one.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Arabic-script letters folded together, digits folded to ASCII, joiners, marks.
LETTERS_FROM, LETTERS_TO = "كيىېةۀأإٱ", "کیییههااا"
DIGITS_FROM, DIGITS_TO = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
SPACED_JOINER, DROPPED_JOINERS = "‌", "‍‎‏"
MARKS = "".join(chr(c) for c in range(0x064B, 0x0653)) + "ٰـ"
#: Letters below U+2000 that decompose to a base letter and marks, with their base; marks themselves go.
_PARTS = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
_BARE = {c: d[0] for c, d in _PARTS.items() if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])}
ACCENTED = "".join(_BARE) + "".join(chr(c) for c in range(0x300, 0x370))
BASE = "".join(_BARE.values())
# Words that a content query leaves out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "of", "to", "in", "on", "at", "by", "for", "with", "about", "into", "from", "as", "is", "are",
    "was", "were", "be", "been", "being", "it", "its", "this", "that", "these", "those", "which", "who", "whom", "what", "where", "when", "how", "why",
    "can", "could", "may", "might", "will", "would", "shall", "should", "do", "does", "did", "done", "have", "has", "had", "not", "no", "yes", "also",
    "than", "so", "such", "their", "them", "they", "there", "here", "he", "she", "his", "her", "we", "us", "our", "you", "your", "i", "me", "my",
    "و", "در", "به", "از", "که", "این", "آن", "را", "با", "است", "برای",
)
# Persian suffixes, first match drops.
SUFFIXES = ("ترین", "های", "ها", "ات", "ان", "تر", "ین", "ی")


def fold(text: str) -> str:
    """Full normal form of one string."""
    s = unicodedata.normalize("NFKC", text).replace(SPACED_JOINER, " ")
    table = {ord(a): b for a, b in zip(LETTERS_FROM + DIGITS_FROM, LETTERS_TO + DIGITS_TO)} | {ord(c): None for c in DROPPED_JOINERS + MARKS}
    return " ".join(s.translate(table).casefold().split())


@F.pandas_udf(StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """Full normal form (compatibility composition and case folding have no built-in)."""
    return texts.map(lambda t: None if t is None else fold(t))


def norm(c: Column) -> Column:
    """Normal form in built-in functions, for text that NFKC leaves as it is.

    translate looks every character up, so it is left to texts that hold one of its characters."""
    folded = F.translate(F.translate(c, SPACED_JOINER, " "), LETTERS_FROM + DIGITS_FROM + DROPPED_JOINERS + MARKS, LETTERS_TO + DIGITS_TO)
    x = F.when(c.rlike("[\u0600-\u06FF\u200C-\u200F]"), folded).otherwise(c)
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def term_key(c: Column) -> Column:
    """The normal form without accents, as postings hold it; translate is left to texts with such letters."""
    x = norm(c)
    return F.when(x.rlike(r"[\u00C0-\u1FFF]"), F.translate(x, ACCENTED, BASE)).otherwise(x)


def apart(df):
    """df with a column _m that keeps a filter (one that also asks for _m >= 0) above df's projection: pushed
    below, it would repeat the projection's text work once for each use."""
    return df.withColumn("_m", F.monotonically_increasing_id())


def terms(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)


def clean_query(c: Column) -> Column:
    """One line, joiners as spaces, no marks; an odd number of quotes drops them all."""
    x = F.translate(F.translate(c, SPACED_JOINER + "\r\n\t", "    "), MARKS + DROPPED_JOINERS, "")
    x = F.trim(F.regexp_replace(x, " +", " "))
    odd = (F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(odd, F.replace(x, F.lit('"'), F.lit(""))).otherwise(x)


def variants(c: Column) -> Column:
    """Spellings of a query: own first, then Persian and Arabic letters with each kind of digits, no repeats."""
    fa, ar = F.translate(c, "كي", "کی"), F.translate(c, "کی", "كي")
    latin, persian, arabic = "0123456789", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
    every = persian + arabic + latin
    forms = [c]
    for letters in (fa, ar):
        forms += [F.translate(letters, every, to * 3) for to in (latin, persian, arabic)]
    return F.array_distinct(F.array(*forms))


def content_terms(c: Column, least: int = 2) -> Column:
    """Distinct terms without stop words and short ones; all terms if none remain."""
    every = F.array_distinct(terms(norm(c)))
    kept = F.filter(every, lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def stem(c: Column) -> Column:
    """Drops the first matching suffix of an Arabic-script term that leaves three letters or more."""
    out = c
    for s in reversed(SUFFIXES):
        out = F.when(c.endswith(s) & (F.length(c) - len(s) >= 3), c.substr(F.lit(1), F.length(c) - len(s))).otherwise(out)
    return out


def matched_terms(wanted: Column, have: Column) -> Column:
    """Terms that stand in ``have`` or whose stem begins one that does."""
    return F.filter(wanted, lambda t: F.exists(have, lambda h: (h == t) | h.startswith(stem(t))))


def hit_count(text: Column, needle: Column) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))).cast("long")


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a 1-based position."""
    before = text.substr(F.lit(1), at - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def context(text: Column, at: Column, size: Column, before: int = 80, after: int = 120) -> Column:
    """Text around a hit on one line."""
    start = F.greatest(at - before, F.lit(1))
    return F.replace(text.substr(start, at - start + size + after), F.lit("\n"), F.lit(" "))


def estimate_tokens(c: Column) -> Column:
    """A quarter token an ASCII character, half a token any other, rounded up."""
    ascii_ = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_ / 4 + (F.length(c) - ascii_) / 2).cast("long")


def fits_budget(c: Column, tokens: int) -> Column:
    return (estimate_tokens(c) <= tokens) & (F.length(c) <= 4 * tokens) & (F.octet_length(c) <= 12 * tokens)


def strip_code(c: Column) -> Column:
    """Without fenced blocks (closed or not) and inline code."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?(```|\z)", ""), r"`[^`\n]*`", "")


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")


def front_matter(c: Column) -> Column:
    """Flat key: value pairs of a leading block; the first of a key wins, nested lines are left out."""
    block = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---(\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]\|#\n]+)"), 1)


def quotes(c: Column, least: int = 15, most: int = 600) -> Column:
    """Quoted passages: straight, curly and angle marks."""
    return F.regexp_extract_all(c, F.lit(r'["“«]([^"“”«»\n]{%d,%d})["”»]' % (least, most)), 1)


def share_of(c: Column, pattern: str) -> Column:
    """Share of characters that match a class, of all that are not white space."""
    solid = F.regexp_replace(c, r"\s", "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise((F.length(solid) - F.length(F.regexp_replace(solid, pattern, ""))) / F.length(solid))


def strip_tags(c: Column) -> Column:
    """Text of HTML: scripts and styles out, tags as spaces, the common entities decoded."""
    x = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


@F.pandas_udf(BooleanType())
def is_mojibake(texts: pd.Series) -> pd.Series:
    """UTF-8 once read as cp1252: writing it as cp1252 and reading it as UTF-8 changes it."""

    def odd(t: str | None) -> bool:
        try:
            return t is not None and t.encode("cp1252").decode("utf-8") != t
        except (UnicodeEncodeError, UnicodeDecodeError):
            return False

    return texts.map(odd)


def redact(c: Column) -> Column:
    """Key values and absolute paths out."""
    x = F.regexp_replace(c, r"(?i)\b(password|token|secret|api[_-]?key)\s*[:=]\s*\S+", "$1=[redacted]")
    return F.regexp_replace(x, r"(?<![\w/:.])/(?:home|root|Users|var|etc)/\S+", "[path]")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), ACCENTED, BASE), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# What stands around a quoted candidate.
EDGE_JUNK = " \t\r\n:;,.…()—–-'\"“”«»*"


def letter_runs(c: Column) -> Column:
    """Runs of a-z, 0-9 and Arabic-block characters of the folded text, one space apart; any other letter splits a word (for text that NFKC leaves as it is)."""
    low = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(SPACED_JOINER), F.lit(" "))
    return F.array_join(F.regexp_extract_all(low, F.lit("([a-z0-9\u0600-\u06FF]+)"), 1), " ")


def bare_quote(c: Column) -> Column:
    """A quote candidate without [references], bold marks and what stands around it."""
    x = F.regexp_replace(c, r"\[[A-Za-z0-9][A-Za-z0-9_\-]{0,40}\]", " ")
    return F.btrim(F.regexp_replace(x, r"\*\*|__", " "), F.lit(EDGE_JUNK))


def unescape_json(c: Column) -> Column:
    """Text with its \\uXXXX escapes decoded; a run of them at once, so that pairs of surrogates become one character."""
    runs = F.regexp_extract_all(c, F.lit(r"((?:\\u[0-9a-fA-F]{4})+)"), 1)
    decoded = F.transform(runs, lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
    between = F.split(c, r"(?:\\u[0-9a-fA-F]{4})+", -1)
    return F.array_join(F.zip_with(between, F.concat(decoded, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def around_line(c: Column, line: Column, radius: int = 45, most: int = 4200) -> Column:
    """The lines around a 1-based line, ``radius`` before it and as many from it on, cut at ``most`` characters."""
    lines = F.split(c, "\n", -1)
    first, end = F.greatest(line - 1 - radius, F.lit(0)), F.least(line - 1 + radius, F.size(lines))
    kept = F.slice(lines, (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def clip_bytes(c: Column, most: int = 400_000) -> Column:
    """The longest prefix of whole characters in ``most`` UTF-8 bytes (at least 4)."""
    b = F.encode(c, "UTF-8")
    inside = lambda p: F.hex(F.substring(b, p, 1)).rlike("^[89AB]")  # noqa: E731  a byte that continues a character
    end = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(b, F.lit(1), end).cast("string"))
