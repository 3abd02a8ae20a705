"""The stored index: built, refreshed, searched; routes merged; shares of a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import retrieve as R
from ..operators import search as S
from ..sources.store import shared_path
from .registry import Tables, query
from .retrieval_queries import QUERY, TEXT_ROUTE
from .search_queries import DOC_TOKENS, TERMS, bm25_sql

_SCORES = "SELECT doc_id, round(score, 6) AS score FROM scored"


@query(bm25_sql(TERMS, False, _SCORES))
def index_search(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "index")
    I.refresh(t.documents, "doc_id", "text", path)
    return I.search(t.spark, path, TERMS, False).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _earlier(t: Tables) -> DataFrame:
    """The documents as they were: some not yet there, some with another text."""
    text = F.when(F.col("doc_id") % 10 == 4, F.concat(F.lit("rely that "), "text")).otherwise(F.col("text"))
    return t.documents.where("doc_id % 10 <> 3").select("doc_id", text.alias("text"))


@query(bm25_sql(TERMS, True, _SCORES))
def index_refresh(t: Tables) -> DataFrame:
    """An index of an earlier state, brought up to date, gives the scores of the present one."""
    path = shared_path(t.spark, "index")
    I.refresh(_earlier(t), "doc_id", "text", path)
    I.refresh(t.documents, "doc_id", "text", path)
    return I.search(t.spark, path, TERMS, True).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT doc_id, len({DOC_TOKENS}) AS l FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'rely that ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3)),
n AS (SELECT doc_id, len({DOC_TOKENS}) AS l FROM documents)
SELECT 1::BIGINT AS gen, count(*) AS documents, sum(l)::BIGINT AS terms, count(*) AS indexed, 0::BIGINT AS lag FROM e
UNION ALL SELECT 2, count(*), sum(l)::BIGINT, count(*) FILTER (doc_id % 10 IN (3, 4)), 0 FROM n UNION ALL SELECT 3, count(*), sum(l)::BIGINT, 0, 0 FROM n""")
def index_generations(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "index")
    I.refresh(_earlier(t), "doc_id", "text", path)
    I.refresh(t.documents, "doc_id", "text", path)
    I.refresh(t.documents, "doc_id", "text", path)
    return I.figures(t.spark, path)


@query(bm25_sql(TERMS, False, _SCORES))
def index_compaction(t: Tables) -> DataFrame:
    """Three generations merged into one set of files, and a later refresh on top: the scores of the present state."""
    path = shared_path(t.spark, "index")
    I.refresh(_earlier(t), "doc_id", "text", path, 100)
    I.refresh(_earlier(t), "doc_id", "text", path)
    I.compact(t.spark, path)
    I.refresh(t.documents, "doc_id", "text", path)
    I.vacuum(t.spark, path, older=0)
    return I.search(t.spark, path, TERMS, False).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {TEXT_ROUTE} SELECT doc_id, list::BIGINT AS list, rank, position FROM tr")
def index_text_route(t: Tables) -> DataFrame:
    """The text route from stored postings."""
    path = shared_path(t.spark, "index")
    I.refresh(t.documents, "doc_id", "text", path)
    return I.text_route(t.spark, path, QUERY).select(F.col("key").alias("doc_id"), "list", "rank", "position")


@query(bm25_sql(TERMS, False, """, tx AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored ORDER BY rank LIMIT 120),
ls AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 60),
u AS (SELECT tx.doc_id, rank, 'text' AS path, 'lang:' || lang AS m FROM tx JOIN documents USING (doc_id) UNION ALL SELECT ls.doc_id, rank, 'long', 'source:' || source FROM ls JOIN documents USING (doc_id))
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(path, ',' ORDER BY path) AS paths, string_agg(DISTINCT m, ',' ORDER BY m) AS matched FROM u GROUP BY doc_id"""))
def routes_fused(t: Tables) -> DataFrame:
    d = t.documents
    text = S.top(S.bm25(d, "doc_id", "text", TERMS, False, "lang"), 120, F.col("score"), F.col("doc_id"))
    long = S.top(d.select("doc_id", "source", "n_chars"), 60, F.desc("n_chars"), F.col("doc_id"))
    named = lambda rows, c: rows.select("doc_id", "rank", F.array_compact(F.array(F.concat(F.lit(f"{c}:"), c))).alias("matched"))
    out = S.fuse_routes({"text": named(text, "lang"), "long": named(long, "source")}, "doc_id")
    return out.select("doc_id", F.round("score", 9).alias("score"), F.array_join("paths", ",").alias("paths"), F.when(F.size("matched") > 0, F.array_join("matched", ",")).alias("matched"))


@query("""WITH n AS (SELECT greatest(count(*), 1) AS n FROM benchmark), c AS (SELECT item_id, text, left(text, ((4000 * 4) // n) * 4) AS content FROM benchmark, n)
SELECT item_id, content, length(text) > length(content) AS truncated, length(content) // 4 AS tokens FROM c""")
def budget_share_pack(t: Tables) -> DataFrame:
    return R.share_pack(t.benchmark, "item_id", "text", 4000)
