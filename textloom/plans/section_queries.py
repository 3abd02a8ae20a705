"""Records built from documents, parsed back into fields and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import front_matter as M
from ..operators import sections as S
from .registry import Tables, query


def _record() -> Column:
    """By doc_id % 6: plain, a section twice, out of order, unclosed, escaped headings, an unknown encoding."""
    case = F.col("doc_id") % 6
    head = F.concat(
        F.lit("---\nid: cap-"), F.col("doc_id"), F.lit("\ntitle: \"of "), F.col("source"), F.lit("\"\nlanguage_hint: "), F.col("lang"), F.lit("\nbytes: 0"), F.col("n_chars"), F.lit("\nquality_flags: [a, "), F.col("lang"), F.lit("]\nextra:\n  deep: 1\n"),
        F.when(case == 4, "body_encoding: escaped-headings-v1\n").when(case == 5, "body_encoding: other\n").otherwise(""), F.when(case == 3, "").otherwise("---\n"),
    )
    user = F.concat(F.lit("\n## User-supplied text\n\n"), F.when(case == 4, F.concat(F.lit("\\## head\n"), F.col("text"))).otherwise(F.col("text")), F.lit("\n"))
    notes = F.concat(F.lit("\n## Review notes\n\nby "), F.col("source"), F.lit("\n"))
    body = F.when(case == 1, F.concat(notes, user, notes)).when(case == 2, F.concat(notes, user)).otherwise(F.concat(user, notes))
    return F.concat(head, body)


@query(r"""SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'unclosed' WHEN 5 THEN 'unknown_encoding' END AS error,
  CASE WHEN doc_id % 6 NOT IN (3, 5) THEN sha256(CASE WHEN doc_id % 6 = 4 THEN '## head' || chr(10) ELSE '' END || text || chr(10)) END AS user_sha256, CASE WHEN doc_id % 6 NOT IN (3, 5) THEN 'by ' || source || chr(10) END AS notes,
  CASE doc_id % 6 WHEN 1 THEN 'twice: Review notes; out of order' WHEN 2 THEN 'out of order' ELSE '' END AS ambiguous
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL""")
def record_sections(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null and source is not null and lang is not null and n_chars is not null")
    df = rows.select("doc_id", S.parse(_record()).alias("p"))
    part = lambda n: F.get(F.filter("p.sections", lambda s: s["name"] == n), F.lit(0))["content"]
    return df.select("doc_id", "p.error", F.sha2(part("User-supplied text"), 256).alias("user_sha256"), part("Review notes").alias("notes"), F.array_join("p.ambiguous", "; ").alias("ambiguous"))


FIELDS_SQL = r"""WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
f AS (SELECT doc_id, 'flat' AS dialect, CASE WHEN doc_id % 6 = 3 THEN NULL ELSE [('id', 'text', 'cap-' || doc_id), ('title', 'text', 'of ' || source), ('language_hint', 'text', lang), ('bytes', 'text', '0' || n_chars), ('quality_flags', 'text', '[a, ' || lang || ']'), ('extra', 'text', '')]
      || CASE doc_id % 6 WHEN 4 THEN [('body_encoding', 'text', 'escaped-headings-v1')] WHEN 5 THEN [('body_encoding', 'text', 'other')] ELSE [] END END AS fs FROM d
  UNION ALL SELECT doc_id, 'capture', CASE WHEN doc_id % 6 = 3 THEN NULL ELSE [('id', 'text', 'cap-' || doc_id), ('title', 'text', 'of ' || source), ('language_hint', 'text', lang), ('bytes', 'int', n_chars::VARCHAR), ('quality_flags', 'list', 'a, ' || lang), ('extra', 'raw', 'deep: 1')]
      || CASE doc_id % 6 WHEN 4 THEN [('body_encoding', 'raw', 'escaped-headings-v1')] WHEN 5 THEN [('body_encoding', 'raw', 'other')] ELSE [] END END FROM d),
u AS (SELECT doc_id, dialect, unnest(fs) AS f, unnest(range(1, len(fs) + 1)) AS place FROM f WHERE fs IS NOT NULL)
SELECT doc_id, dialect, NULL::VARCHAR AS error, place::BIGINT AS place, f[1] AS name, f[2] AS kind, f[3] AS value FROM u
UNION ALL SELECT doc_id, dialect, CASE WHEN dialect = 'capture' THEN 'unclosed' END, NULL, NULL, NULL, NULL FROM f WHERE fs IS NULL"""


@query(FIELDS_SQL)
def front_matter_fields(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null and source is not null and lang is not null and n_chars is not null").select("doc_id", _record().alias("record"))
    parts = [S.field_rows(rows, "doc_id", p).withColumn("dialect", F.lit(n)) for n, p in (("flat", M.flat(F.col("record"))), ("capture", M.capture(F.col("record"), S.FIELDS)))]
    return parts[0].unionByName(parts[1]).select("doc_id", "dialect", "error", "place", "name", "kind", "value")
