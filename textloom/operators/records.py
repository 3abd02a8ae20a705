"""Records: projections into layers, annotation checks, containment and suffix joins, drift repairs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T


def layers(rows: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """key, ordinal, layer, text, text_sha256, chars, bytes of the parts that hold text, in order."""
    named = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(F.lit(n).alias("layer"), c.alias("text"))) for n, c in parts.items()]))
    df = rows.select(key, F.posexplode(named).alias("ordinal", "x")).select(key, F.col("ordinal").cast("long").alias("ordinal"), "x.layer", "x.text")
    return df.withColumn("text_sha256", F.sha2("text", 256)).withColumn("chars", F.length("text").cast("long")).withColumn("bytes", F.octet_length("text").cast("long"))


def has_body(text: Column, header: str = r"^(\s*$|#|>|---|[A-Za-z_]+:)") -> Column:
    """Whether any line follows the leading header lines."""
    return F.exists(F.split(text, "\n"), lambda x: ~x.rlike(header))


def flags(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


def mentions(rows: DataFrame, key: str, text: str, ids: DataFrame, name: str, pattern: str) -> DataFrame:
    """key, name: known identifiers in a text. Identifiers have a shape, so texts and names meet on tokens, not pair by pair."""
    found = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), 1))).alias(name))
    return found.join(ids.select(name).distinct(), name, "left_semi").select(key, name)


def by_suffix(rows: DataFrame, path: str, names: DataFrame, full: str, ident: str) -> DataFrame:
    """Adds ident: of the equal path, else of the least path with the same last part; of equal paths the least ident."""
    last = lambda c: F.regexp_extract(c, r"([^/]+)/*$", 1)
    exact = names.groupBy(F.col(full).alias("_f")).agg(F.min(ident).alias("_e"))
    known = names.where(F.col(full).isNotNull() & F.col(ident).isNotNull())
    base = known.groupBy(last(F.col(full)).alias("_b")).agg(F.min(F.struct(F.col(full).alias("p"), F.col(ident).alias("i")))["i"].alias("_s"))
    j = rows.join(exact, F.col(path) == F.col("_f"), "left").withColumn("_l", last(F.col(path))).join(base, F.col("_l") == F.col("_b"), "left")
    return j.withColumn(ident, F.coalesce("_e", "_s")).drop("_f", "_e", "_l", "_b", "_s")


def annotation_problems(annotations: DataFrame, key: str, chunks: DataFrame, chunk: str, text: str) -> DataFrame:
    """key, problem of annotations (summary, tags, chunk, mention): limits, repeats, unknown chunks, mentions not as written."""
    c = chunks.select(F.col(chunk).alias("_c"), F.col(text).alias("_t"))
    j = annotations.join(c, F.col(chunk) == F.col("_c"), "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    problem = flags({
        "summary_long": F.length("summary") > 800, "many_tags": F.size(tags) > 12, "long_tag": F.exists(tags, lambda t: F.length(t) > 64), "repeated_tag": F.size(F.array_distinct(tags)) < F.size(tags),
        "unknown_chunk": F.col("_c").isNull(), "mention_not_found": F.col("_c").isNotNull() & ~F.contains(F.col("_t"), F.col("mention")),
    })
    return j.select(key, F.explode(problem).alias("problem"))


def escape_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(\\*)##", r"\\$1##")


def unescape_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\\(\\*)##", "$1##")


@F.pandas_udf(StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first {...} that parses, nested or not; else null (there is no built-in that finds where an object ends)."""
    decode = json.JSONDecoder().raw_decode

    def first(t: str | None) -> str | None:
        for m in re.finditer(r"\{", t or ""):
            try:
                return t[m.start() : decode(t, m.start())[1]]
            except (ValueError, RecursionError):
                continue
        return None

    return texts.map(first)


def tei(ident: Column, title: Column, body: Column) -> Column:
    """A TEI skeleton of one text."""
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="s'), ident.cast("string"), F.lit('"><teiHeader><fileDesc><titleStmt><title>'), clean(title), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body><p>"), clean(body), F.lit("</p></body></text></TEI>"))


def repairs(errors: DataFrame, message: str) -> DataFrame:
    """path, op, field, value parsed from messages ``path: missing field`` and ``path: field must be value``."""
    m = F.col(message)
    path, rest = F.regexp_extract(m, r"^([^:]+): ", 1), F.regexp_extract(m, r"^[^:]+: (.*)$", 1)
    miss, must = F.regexp_extract(rest, r"^missing (\w+)$", 1), F.regexp_extract(rest, r"^(\w+) must be (.+)$", 1)
    op = F.when(miss != "", "insert").when(must != "", "set")
    return errors.select(path.alias("path"), op.alias("op"), F.when(miss != "", miss).otherwise(must).alias("field"), F.regexp_extract(rest, r" must be (.+)$", 1).alias("value")).where("op is not null")


def quote_audit(quotes: DataFrame, key: str, quote: str, rows: DataFrame, source: str, text: str) -> DataFrame:
    """key, status: whether a quote of a named source stands in it (ok), only its start does (partial), the source is unknown or it fails."""
    s = rows.select(F.col(source).alias("_s"), T.norm(F.col(text)).alias("_t"))
    j = quotes.join(s, F.col(source) == F.col("_s"), "left").withColumn("_q", T.norm(F.col(quote)))
    status = F.when(F.col("_s").isNull(), "unknown_source").when(F.contains("_t", F.col("_q")), "ok").when(F.contains("_t", F.substring("_q", 1, 20)), "partial").otherwise("failed")
    return j.select(key, status.alias("status"))
