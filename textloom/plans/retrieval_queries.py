"""Composed retrieval, inventories, citations, exports and record checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import census as N
from ..operators import graph as G
from ..operators import retrieve as R
from ..operators import search as S
from .registry import Tables, query
from .search_queries import DOC_TOKENS, META_SQL, TERMS, TOKENS, _meta, bm25_sql

QUERY = "rely thtion"
_STRICT = bm25_sql(["rely", "thtion"], True, "SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored ORDER BY rank LIMIT 120")
_ANY = bm25_sql(["rely", "thtion"], False, "SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored ORDER BY rank LIMIT 120")
TEXT_ROUTE = f"""st AS ({_STRICT}), an AS ({_ANY}),
bo AS (SELECT doc_id, 1 AS list, rank FROM st UNION ALL SELECT doc_id, 2, rank FROM an),
on1 AS (SELECT doc_id, list, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list, rank) AS k FROM bo) WHERE k = 1),
tr AS (SELECT doc_id, list, rank, row_number() OVER (ORDER BY list, rank) AS position FROM on1 ORDER BY list, rank LIMIT 120)"""


@query(f"WITH {TEXT_ROUTE} SELECT doc_id, list::BIGINT AS list, rank, position FROM tr")
def text_route(t: Tables) -> DataFrame:
    return R.text_route(t.documents, "doc_id", "text", QUERY)


@query(META_SQL.replace("WITH x", f"WITH {TEXT_ROUTE}, x", 1) + rf""",
mq AS (SELECT doc_id, field, {TOKENS.format('norm')} AS ts FROM meta),
mm AS (SELECT doc_id, CASE WHEN list_sort(list_distinct(ts)) = ['rely', 'thtion'] THEN 0 WHEN len(list_intersect(ts, ['rely', 'thtion'])) = 2 THEN 1 WHEN len(list_intersect(ts, ['rely', 'thtion'])) >= 1 THEN 2 END AS quality,
  list_position(['entity', 'topic', 'tag', 'summary'], field) - 1 AS priority FROM mq),
mb AS (SELECT doc_id, quality, priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, priority) AS k FROM mm WHERE quality IS NOT NULL) WHERE k = 1),
mr AS (SELECT doc_id, row_number() OVER (ORDER BY quality, priority, doc_id) AS rank FROM mb ORDER BY rank LIMIT 60),
fu AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT doc_id, position AS rank FROM tr UNION ALL SELECT doc_id, rank FROM mr) GROUP BY doc_id),
jo AS (SELECT fu.doc_id, source, score, fu.doc_id IN (SELECT doc_id FROM tr) AS direct FROM fu JOIN documents USING (doc_id)),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, direct DESC, doc_id) AS k FROM jo) WHERE k <= 3)
SELECT doc_id, source, round(score, 9) AS score, direct, row_number() OVER (ORDER BY score DESC, direct DESC, doc_id) AS rank FROM ca ORDER BY rank LIMIT 10""")
def retrieve_fused(t: Tables) -> DataFrame:
    return R.retrieve(t.documents, "doc_id", "text", "source", _meta(t), QUERY, ["entity", "topic", "tag", "summary"])


@query(bm25_sql(TERMS, True, """, h AS (SELECT doc_id, score FROM scored), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT doc_id, 1::BIGINT AS route FROM h UNION ALL (SELECT doc_id, 2 FROM b WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY rank LIMIT 50)"""))
def fallback_supplement(t: Tables) -> DataFrame:
    hits = S.bm25(t.documents, "doc_id", "text", TERMS, True)
    return R.fallback(hits, t.documents.select("doc_id", "n_chars"), "doc_id", F.desc("n_chars"), F.col("doc_id"))


@query(bm25_sql(TERMS, False, "SELECT doc_id FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def fresh_hits(t: Tables) -> DataFrame:
    return R.fresh(S.bm25(t.documents, "doc_id", "text", TERMS, False), t.labels.where("quality = 1"), "doc_id").select("doc_id")


@query("""WITH a AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 12), b AS (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25),
u AS (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, rank) AS k FROM u) WHERE k = 1)
SELECT doc_id, part::BIGINT AS part, row_number() OVER (ORDER BY part, rank, doc_id) AS place, left(text, 200) AS excerpt FROM o ORDER BY part, rank, doc_id LIMIT 30""")
def context_pack(t: Tables) -> DataFrame:
    d = t.documents
    seed = S.top(d.where("lang = 'es'").select("doc_id", "text"), 12, F.col("doc_id"))
    fill = S.top(d.select("doc_id", "text", "n_chars"), 25, F.desc("n_chars"), F.col("doc_id"))
    return R.pack([seed, fill.select("doc_id", "text", "rank")], "doc_id", "text", 30, 200)


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER w AS place, sum(length(text)) OVER w AS running FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, place, running::BIGINT AS running FROM r WHERE place = 1 OR (running <= 600 AND place <= 20)""")
def pending_page(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return R.pending_page(rows, "conv_id", ["turn"], "n", 600).select("conv_id", "turn", "place", "running")


@query("""WITH a AS (SELECT doc_id::VARCHAR AS ref, 'record' AS role FROM documents UNION ALL SELECT 'c' || conv_id, 'capture' FROM conversations UNION ALL SELECT 'p' || page_id, 'page' FROM pages)
SELECT role, count(DISTINCT ref) AS refs, count(*) AS paths, substr(sha256(string_agg(DISTINCT ref, chr(10) ORDER BY ref)), 1, 12) AS generation FROM a GROUP BY role""")
def source_inventory(t: Tables) -> DataFrame:
    parts = t.documents.select(F.col("doc_id").cast("string").alias("ref"), F.lit("record").alias("role"))
    parts = parts.unionByName(t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("ref"), F.lit("capture").alias("role")))
    parts = parts.unionByName(t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("ref"), F.lit("page").alias("role")))
    refs = parts.groupBy("role", "ref").agg(F.count("*").alias("n"))
    digest = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("ref")), "\n"), 256), 1, 12)
    return refs.groupBy("role").agg(F.count("*").alias("refs"), F.sum("n").alias("paths"), digest.alias("generation"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([0-9]{2,4})\b', 1)) AS x FROM documents), d AS (SELECT DISTINCT doc_id, x::BIGINT AS dst FROM c),
r AS (SELECT doc_id, dst, row_number() OVER (PARTITION BY doc_id ORDER BY dst) AS k FROM d WHERE dst IN (SELECT doc_id FROM documents)) SELECT doc_id, dst FROM r WHERE k <= 50""")
def citation_edges(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([0-9]{2,4})\b"), 1))).alias("x")).select("doc_id", F.col("x").cast("long").alias("dst")).distinct()
    real = found.join(t.documents.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    return S.top(real, 50, F.col("dst"), by=("doc_id",)).select("doc_id", "dst")


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '"([^"\n<>=]{15,600})"', 1)) AS quote FROM pages""")
def quote_extraction(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'"([^"\n<>=]{15,600})"'), 1)).alias("quote"))


@query("""SELECT event_id, json_extract_string(props, concat('$.', (json_keys(props::JSON))[1])) AS first_value, len(json_keys(props::JSON))::BIGINT AS n_keys FROM events WHERE props IS NOT NULL""")
def json_fields(t: Tables) -> DataFrame:
    keys = F.json_object_keys("props")
    return t.events.where("props is not null").select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("""SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y%m') AS month, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2""")
def date_partitions(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "yyyyMM").alias("month"))
    return d.groupBy("year", "month").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'stale' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'due' ELSE 'fresh' END AS state FROM orders) SELECT state, count(*) AS n FROM d GROUP BY state""")
def register_freshness(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    state = F.when(d < "1996-01-01", "stale").when(d < "1998-01-01", "due").otherwise("fresh")
    return t.orders.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _days(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("ts_day"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS ts_day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def chronology(t: Tables) -> DataFrame:
    return _days(t.events)


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'withheld' WHEN quality = 1 AND toxic = 0 THEN 'exported' ELSE 'withheld' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def public_export_gate(t: Tables) -> DataFrame:
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.when(ok, "exported").otherwise("withheld").alias("outcome"))


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l WHERE l.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)""")
def missing_parts(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return N.uncovered(rows, "l_partkey", t.part.where("p_size > 3").select(F.col("p_partkey").alias("l_partkey"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH e AS (SELECT c_custkey AS a, c_nationkey AS b FROM customer), d AS (SELECT b, count(DISTINCT a) AS n FROM e GROUP BY b) SELECT b::BIGINT AS nation, n AS customers, n > 24 AS hub FROM d""")
def ambiguous_hubs(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count_distinct("c_custkey").alias("customers")).withColumn("hub", F.col("customers") > G.HUB_DEGREE)


@query(f"""WITH d AS (SELECT doc_id, lang, {DOC_TOKENS} AS ts FROM documents) SELECT lang, count(*) FILTER (len(ts) < 100) AS short_ones, count(*) FILTER (len(ts) >= 100) AS long_ones, max(len(ts))::BIGINT AS most FROM d GROUP BY lang""")
def word_count_release(t: Tables) -> DataFrame:
    d = t.documents.select("lang", F.size(T.terms(T.term_key(F.col("text")))).alias("n"))
    return d.groupBy("lang").agg(F.count_if(F.col("n") < 100).alias("short_ones"), F.count_if(F.col("n") >= 100).alias("long_ones"), F.max("n").cast("long").alias("most"))
