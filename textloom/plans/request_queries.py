"""Requests as rows: checks, phrases, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import planning as P
from .registry import Tables, query


@query(r"""SELECT doc_id, CASE WHEN doc_id % 6 IN (1, 4, 5) THEN 'E_BAD_ARGUMENTS' WHEN doc_id % 6 = 2 THEN 'E_UNKNOWN_ARGUMENT' END AS error, CASE doc_id % 6 WHEN 1 THEN 'limit' WHEN 2 THEN 'depth' WHEN 4 THEN 'query,scope' ELSE '' END AS wrong,
  CASE WHEN doc_id % 6 IN (0, 3) THEN trim(source) END AS query, CASE doc_id % 6 WHEN 0 THEN 'all' WHEN 3 THEN 'captures' END AS scope, CASE doc_id % 6 WHEN 0 THEN doc_id % 50 + 1 WHEN 3 THEN 10 END AS "limit", CASE WHEN doc_id % 6 IN (0, 3) THEN 4000::BIGINT END AS budget_tokens, CASE doc_id % 6 WHEN 3 THEN lang END AS cursor
FROM documents WHERE trim(source) <> '' AND length(lang) > 0""")
def request_checks(t: Tables) -> DataFrame:
    i, q = F.col("doc_id"), F.concat(F.lit('{"query": " '), F.col("source"), F.lit(' "'))
    text = (
        F.when(i % 6 == 0, F.concat(q, F.lit(', "limit": '), i % 50 + 1, F.lit("}"))).when(i % 6 == 1, F.concat(q, F.lit(', "limit": "'), i % 50 + 1, F.lit('"}'))).when(i % 6 == 2, F.concat(q, F.lit(', "depth": 1}')))
        .when(i % 6 == 3, F.concat(q, F.lit(', "scope": "captures", "cursor": "'), F.col("lang"), F.lit('"}'))).when(i % 6 == 4, F.lit('{"query": 7, "scope": "none"}')).otherwise(q)
    )
    rows = t.documents.where("trim(source) <> '' and length(lang) > 0").select("doc_id", text.alias("request"))
    return P.checked(rows, "doc_id", "request")


@query(r"""WITH w AS (SELECT page_id, string_split(replace(url, '?', ' '), ' ') AS ws FROM pages)
SELECT page_id, array_to_string([CASE WHEN regexp_matches(x, '\w[-_./:]\w') AND NOT starts_with(x, '-') AND len([p FOR p IN string_split_regex(x, '[-_./:]+') IF p <> '']) > 1 THEN '"' || array_to_string([p FOR p IN string_split_regex(x, '[-_./:]+') IF p <> ''], ' ') || '"' ELSE x END FOR x IN ws IF x <> ''], ' ') AS phrases FROM w""")
def query_phrases(t: Tables) -> DataFrame:
    """Each page's url as a query: its parts as phrases."""
    return t.pages.select("page_id", P.phrases(F.replace("url", F.lit("?"), F.lit(" "))).alias("phrases"))


@query(r"""SELECT doc_id, 'rec:' || lang || '-' || doc_id || ',chk:' || md5(source) || ',cap:cap-20240101-' || printf('%06d', doc_id % 1000000) || '-' || left(md5(source), 4) || ',rec:' || source || '-note' AS refs
FROM documents WHERE regexp_matches(source, '^[A-Za-z0-9]+$') AND regexp_matches(lang, '^[a-z]+$')""")
def query_references(t: Tables) -> DataFrame:
    i, digest = F.col("doc_id"), F.md5("source")
    rec = F.concat(F.lit("rec:"), F.col("lang"), F.lit("-"), i)
    text = F.concat(F.lit("see "), rec, F.lit(", chk:"), digest, F.lit(" ("), rec, F.lit(") or cap-20240101-"), F.format_string("%06d", i % 1000000), F.lit("-"), F.substring(digest, 1, 4), F.lit(" and "), F.col("source"), F.lit("-note; plainword"))
    rows = t.documents.where(F.col("source").rlike("^[A-Za-z0-9]+$") & F.col("lang").rlike("^[a-z]+$"))
    return rows.select("doc_id", F.array_join(P.references(text), ",").alias("refs"))
