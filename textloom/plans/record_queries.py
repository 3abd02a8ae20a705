"""Record projections, checks and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R
from .registry import Tables, query
from .search_queries import NORM


@query(r"""WITH l AS (SELECT doc_id, unnest(list_filter([CASE WHEN trim(coalesce(source, '')) <> '' THEN {'layer': 'origin', 'text': source} END, CASE WHEN trim(coalesce(text, '')) <> '' THEN {'layer': 'body', 'text': text} END], lambda x: x IS NOT NULL)) AS x,
  unnest(range(0, (CASE WHEN trim(coalesce(source, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END))) AS ordinal FROM documents)
SELECT doc_id, ordinal::BIGINT AS ordinal, x.layer AS layer, sha256(x.text) AS text_sha256, length(x.text)::BIGINT AS chars, strlen(x.text)::BIGINT AS bytes FROM l""")
def record_layers(t: Tables) -> DataFrame:
    return R.layers(t.documents, "doc_id", {"origin": F.col("source"), "body": F.col("text")}).drop("text")


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^(\s*$|#|>|---|[A-Za-z_]+:)'))) > 0 AS has_body,
  array_to_string(list_filter([CASE WHEN n_chars > 4000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, '###') THEN 'marks' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""")
def record_flags(t: Tables) -> DataFrame:
    f = R.flags({"long": F.col("n_chars") > 4000, "foreign": F.col("lang") != "en", "marks": F.contains("text", F.lit("###"))})
    return t.documents.select("doc_id", R.has_body(F.col("text")).alias("has_body"), F.array_join(f, ",").alias("flags"))


@query(r"""WITH f AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(\b[a-z]+\.example\.[a-z]+)', 1)) AS host FROM pages) SELECT page_id, host FROM f WHERE host IN (SELECT regexp_extract(url, '://([^/]+)', 1) FROM pages)""")
def identifier_mentions(t: Tables) -> DataFrame:
    ids = t.pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return R.mentions(t.pages, "page_id", "html", ids, "host", r"\b[a-z]+\.example\.[a-z]+")


@query(r"""WITH n AS (SELECT page_id AS ident, url AS p, regexp_extract(url, '([^/]+)/*$', 1) AS b FROM pages), e AS (SELECT p, min(ident) AS i FROM n GROUP BY p), s AS (SELECT b, arg_min(ident, p) AS i FROM n GROUP BY b),
r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'x/' || regexp_extract(url, '([^/]+)/*$', 1) END AS path FROM pages)
SELECT page_id, path, coalesce(e.i, s.i) AS ident FROM r LEFT JOIN e ON r.path = e.p LEFT JOIN s ON regexp_extract(r.path, '([^/]+)/*$', 1) = s.b""")
def path_suffix_join(t: Tables) -> DataFrame:
    last = F.regexp_extract("url", r"([^/]+)/*$", 1)
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("x/"), last)).alias("path"))
    return R.by_suffix(rows, "path", t.pages.select(F.col("page_id").alias("ident"), "url"), "url", "ident")


@query(r"""WITH a AS (SELECT item_id, text AS summary, CASE WHEN item_id % 4 = 0 THEN ['a', 'a'] ELSE ['a', 'b'] END AS tags, item_id * 3 AS doc_id, left(text, 12) AS mention FROM benchmark),
j AS (SELECT a.*, d.doc_id AS c, d.text AS t FROM a LEFT JOIN documents d ON d.doc_id = a.doc_id)
SELECT item_id, unnest(list_filter([CASE WHEN length(summary) > 800 THEN 'summary_long' END, CASE WHEN tags[1] = tags[2] THEN 'repeated_tag' END, CASE WHEN c IS NULL THEN 'unknown_chunk' END, CASE WHEN c IS NOT NULL AND NOT contains(t, mention) THEN 'mention_not_found' END], lambda x: x IS NOT NULL)) AS problem FROM j""")
def annotation_problems(t: Tables) -> DataFrame:
    tags = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    a = t.benchmark.select("item_id", F.col("text").alias("summary"), tags.alias("tags"), (F.col("item_id") * 3).alias("doc_id"), F.substring("text", 1, 12).alias("mention"))
    return R.annotation_problems(a, "item_id", t.documents.select("doc_id", "text"), "doc_id", "text")


@query(r"""WITH d AS (SELECT doc_id, '## ' || replace(text, chr(10), chr(10) || '## ') AS x FROM documents), e AS (SELECT doc_id, x, regexp_replace(x, '(?m)^(\\*)##', '\\\1##', 'g') AS y FROM d)
SELECT doc_id, sha256(y) AS escaped, regexp_replace(y, '(?m)^\\(\\*)##', '\1##', 'g') = x AS done, (length(x) - length(replace(x, '## ', ''))) // 3 AS headings FROM e""")
def heading_escapes(t: Tables) -> DataFrame:
    return _escaped(t.documents)


def _escaped(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("x"))
    y = R.escape_headings(F.col("x"))
    there_and_back = R.unescape_headings(y) == F.col("x")
    return d.select("doc_id", F.sha2(y, 256).alias("escaped"), there_and_back.alias("done"), ((F.length("x") - F.length(F.replace("x", F.lit("## "), F.lit("")))) / 3).cast("long").alias("headings"))


@query(r"""SELECT event_id, props AS found, '{"a":{"b":' || props || '}}' AS nested FROM events""")
def first_json_object(t: Tables) -> DataFrame:
    return _first_json(t.events)


def _first_json(events: DataFrame) -> DataFrame:
    e = events.select("event_id", F.concat(F.lit("noise {not json} "), F.col("props"), F.lit(' {"b":2}')).alias("x"), F.concat(F.lit('{ {"a":{"b":'), F.col("props"), F.lit("}} }")).alias("y"))
    return e.select("event_id", R.first_json_object(F.col("x")).alias("found"), R.first_json_object(F.col("y")).alias("nested"))


@query(r"""SELECT doc_id, '<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="s' || doc_id || '"><teiHeader><fileDesc><titleStmt><title>' || replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title></titleStmt></fileDesc></teiHeader><text><body><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></body></text></TEI>' AS tei FROM documents""")
def tei_export(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.tei(F.col("doc_id"), F.col("source"), F.col("text")).alias("tei"))


@query(r"""SELECT 'doc' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'insert' ELSE 'set' END AS op, CASE WHEN doc_id % 3 = 0 THEN 'lang' ELSE 'source' END AS field, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS value FROM documents WHERE doc_id % 3 <> 2""")
def schema_repairs(t: Tables) -> DataFrame:
    p = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    m = F.when(F.col("doc_id") % 3 == 0, F.concat(p, F.lit(": missing lang"))).when(F.col("doc_id") % 3 == 1, F.concat(p, F.lit(": source must be "), F.col("lang"))).otherwise(F.lit("all fine"))
    return R.repairs(t.documents.select(m.alias("message")), "message")


@query(f"""WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN left(text, 60) ELSE left(text, 25) || ' changed' END AS quote, CASE WHEN item_id % 5 = 4 THEN -1 ELSE item_id END AS doc_id FROM benchmark),
j AS (SELECT q.item_id, d.doc_id AS s, {NORM.format('d.text')} AS t, {NORM.format('q.quote')} AS q FROM q LEFT JOIN documents d ON d.doc_id = q.doc_id)
SELECT item_id, CASE WHEN s IS NULL THEN 'unknown_source' WHEN contains(t, q) THEN 'ok' WHEN contains(t, left(q, 20)) THEN 'partial' ELSE 'failed' END AS status FROM j""")
def quote_audit(t: Tables) -> DataFrame:
    q = F.when(F.col("item_id") % 3 == 0, F.substring("text", 1, 60)).otherwise(F.concat(F.substring("text", 1, 25), F.lit(" changed")))
    rows = t.benchmark.select("item_id", q.alias("quote"), F.when(F.col("item_id") % 5 == 4, -1).otherwise(F.col("item_id")).alias("doc_id"))
    return R.quote_audit(rows, "item_id", "quote", t.documents.select("doc_id", "text"), "doc_id", "text")
