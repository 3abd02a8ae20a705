"""Search, fusion and paging over documents, conversations and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing as P
from ..operators import search as S
from .registry import Tables, query

#: Search terms that occur in the synthetic corpus.
TERMS = ["thtion", "rely", "that"]
NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
KEY = f"translate({NORM}, 'äçèéêíñóöü', 'aceeeinoou')"
TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
DOC_TOKENS = TOKENS.format(KEY.format("text"))


def bm25_sql(terms: list[str], every: bool, select: str) -> str:
    """Common table expression ``scored`` of (doc_id, source, lang, score), then ``select``."""
    f = ", ".join(f"len(list_filter(ts, lambda t: t = '{t}')) AS f{i}" for i, t in enumerate(terms))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    idf = [f"CASE WHEN ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) END" for i in range(len(terms))]
    score = " ".join(f"- ({idf[i]}) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))" for i in range(len(terms)))
    keep = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"""
WITH tok AS (SELECT doc_id, source, lang, {DOC_TOKENS} AS ts FROM documents),
f AS (SELECT doc_id, source, lang, len(ts) AS l, {f} FROM tok),
g AS (SELECT count(*) AS n, avg(l) AS a, {d} FROM f),
scored AS (SELECT doc_id, source, lang, round(0.0 {score}, 9) AS score FROM f, g WHERE {keep})
{select}"""


@query(bm25_sql(TERMS, False, "SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored ORDER BY score, doc_id LIMIT 10"))
def bm25_topk_documents(t: Tables) -> DataFrame:
    hits = S.bm25(t.documents, "doc_id", "text", TERMS, False)
    return S.top(hits, 10, F.col("score"), F.col("doc_id")).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(bm25_sql(TERMS, True, "SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored ORDER BY score, doc_id LIMIT 120"))
def bm25_all_terms(t: Tables) -> DataFrame:
    hits = S.bm25(t.documents, "doc_id", "text", TERMS, True)
    return S.top(hits, 120, F.col("score"), F.col("doc_id")).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(bm25_sql(TERMS, False, "SELECT lang, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS rank FROM scored) WHERE rank <= 5"))
def bm25_topk_by_group(t: Tables) -> DataFrame:
    hits = S.bm25(t.documents, "doc_id", "text", TERMS, False, "lang")
    return S.top(hits, 5, F.col("score"), F.col("doc_id"), by=("lang",)).select("lang", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(bm25_sql(TERMS, False, "SELECT doc_id, source, in_source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) AS in_source FROM scored) WHERE in_source <= 3"))
def per_source_cap(t: Tables) -> DataFrame:
    hits = S.bm25(t.documents, "doc_id", "text", TERMS, False, "source")
    return S.capped(hits, "source", [F.col("score"), F.col("doc_id")]).select("doc_id", "source", "in_source")


@query(f"""
WITH p AS (SELECT doc_id, lang, unnest({DOC_TOKENS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term""")
def postings_statistics(t: Tables) -> DataFrame:
    p = S.postings(t.documents, "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


LOW = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[ \t]+', ' ', 'g')"
NEEDLE = "of the"


@query(f"""
WITH h AS (SELECT doc_id, {LOW.format('text')} AS h FROM documents),
m AS (SELECT doc_id, h, string_split(h, '{NEEDLE}') AS parts, strpos(h, '{NEEDLE}') AS pos FROM h WHERE contains(h, '{NEEDLE}')),
b AS (SELECT doc_id, h, pos, len(parts) - 1 AS n, list_transform(parts[1 : len(parts) - 1], lambda p: length(p) - length(replace(p, chr(10), ''))) AS br FROM m),
l AS (SELECT doc_id, h, pos, n, list_transform(range(1, len(br) + 1), lambda i: 1 + list_sum(br[1 : i])) AS ls FROM b),
u AS (SELECT doc_id, unnest(ls)::BIGINT AS x FROM l),
d AS (SELECT doc_id, list(DISTINCT x ORDER BY x) AS xs FROM u GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS hit_count, array_to_string(xs[1:3], ',') AS lines,
  replace(substr(h, greatest(pos - 80, 1), pos - greatest(pos - 80, 1) + {len(NEEDLE)} + 120), chr(10), ' ') AS context
FROM l JOIN d USING (doc_id)""")
def exact_substring_hits(t: Tables) -> DataFrame:
    return S.exact(t.documents, "doc_id", "text", NEEDLE)


LADDER_QUERY = "the thtion rely"


@query(rf"""
WITH tok AS (SELECT doc_id, lang, {TOKENS.format(NORM.format('text'))} AS ts FROM documents),
s AS (SELECT doc_id, lang, CASE WHEN list_has_all(ts, ['the', 'thtion', 'rely']) THEN 1 WHEN list_has_all(ts, ['thtion', 'rely']) THEN 2 WHEN list_has_any(ts, ['thtion', 'rely']) THEN 4 END AS step FROM tok)
SELECT doc_id, lang, step::BIGINT AS step FROM s WHERE step = (SELECT min(step) FROM s s2 WHERE s2.lang IS NOT DISTINCT FROM s.lang)""")
def ladder_first_step(t: Tables) -> DataFrame:
    return S.ladder(t.documents, "doc_id", "text", LADDER_QUERY, "lang")


def _meta(t: Tables) -> DataFrame:
    head = F.regexp_extract("text", r"^([^.\n]*)", 1)
    return S.metadata_rows(t.documents, "doc_id", {"topic": F.array(F.col("source")), "tag": F.array(F.col("lang")), "summary": F.array(head), "entity": F.slice(T.terms(F.col("text")), 1, 2)})


META_SQL = rf"""
WITH x AS (
  SELECT doc_id, 'topic' AS field, source AS value FROM documents UNION ALL SELECT doc_id, 'tag', lang FROM documents
  UNION ALL SELECT doc_id, 'summary', regexp_extract(text, '^([^.\n]*)', 1) FROM documents
  UNION ALL SELECT doc_id, 'entity', unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')[1:2]) FROM documents),
n AS (SELECT doc_id, field, value, {NORM.format('value')} AS norm FROM x),
meta AS (SELECT doc_id, field, norm, min(value) AS value FROM n WHERE norm <> '' GROUP BY ALL)
"""


@query(META_SQL + "SELECT doc_id, field, norm, value FROM meta")
def meta_rows_flatten(t: Tables) -> DataFrame:
    return _meta(t)


@query(META_SQL + rf""",
q AS (SELECT doc_id, field, {TOKENS.format('norm')} AS ts FROM meta),
m AS (SELECT doc_id, field, CASE WHEN list_sort(list_distinct(ts)) = ['en', 'the'] THEN 0 WHEN len(list_intersect(ts, ['the', 'en'])) = 2 THEN 1 WHEN len(list_intersect(ts, ['the', 'en'])) >= 1 THEN 2 END AS quality,
  list_position(['entity', 'topic', 'tag', 'summary'], field) - 1 AS priority FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, priority, field) AS k FROM m WHERE quality IS NOT NULL)
SELECT doc_id, quality::BIGINT AS quality, priority::BIGINT AS priority, field FROM r WHERE k = 1""")
def meta_hits_ordered(t: Tables) -> DataFrame:
    return S.metadata_hits(_meta(t), "doc_id", "the en", ["entity", "topic", "tag", "summary"])


RANKS_SQL = """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 60),
b AS (SELECT doc_id, row_number() OVER (ORDER BY quality DESC, doc_id) AS rank FROM labels ORDER BY rank LIMIT 60)
"""


def _ranks(t: Tables) -> tuple[DataFrame, DataFrame]:
    return S.top(t.documents.select("doc_id", "n_chars"), 60, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "rank"), S.top(t.labels.select("doc_id", "quality"), 60, F.desc("quality"), F.col("doc_id")).select("doc_id", "rank")


@query(RANKS_SQL + "SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS n_lists FROM (FROM a UNION ALL FROM b) GROUP BY doc_id")
def rrf_fusion(t: Tables) -> DataFrame:
    return S.fuse(list(_ranks(t)), "doc_id")


@query(RANKS_SQL + """, u AS (SELECT *, 'a' AS g FROM a UNION ALL SELECT *, 'b' FROM b),
f AS (SELECT doc_id, rank, g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, g) AS k FROM u) WHERE k = 1)
SELECT doc_id, rank, g, row_number() OVER (ORDER BY rank, g) AS position FROM f ORDER BY rank, g LIMIT 20""")
def interleave_groups(t: Tables) -> DataFrame:
    a, b = _ranks(t)
    return S.interleave(a.withColumn("g", F.lit("a")).unionByName(b.withColumn("g", F.lit("b"))), "g", "doc_id", 20).select("doc_id", "rank", "g", "position")


@query(RANKS_SQL + "SELECT doc_id, list, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list, rank) AS k FROM (SELECT doc_id, rank, 1 AS list FROM a UNION ALL SELECT doc_id, rank, 2 FROM b)) WHERE k = 1")
def union_first_list_wins(t: Tables) -> DataFrame:
    a, b = _ranks(t)
    return S.union_first(a, b, "doc_id")


@query(bm25_sql(TERMS, False, """, r AS (SELECT doc_id, source, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored)
SELECT d.source, coalesce(max(h.doc_id), min(d.doc_id)) AS doc_id FROM documents d
LEFT JOIN (SELECT source, arg_min(doc_id, rank) AS doc_id FROM r GROUP BY source) h USING (source) GROUP BY d.source"""))
def representative_document(t: Tables) -> DataFrame:
    hits = S.bm25(t.documents, "doc_id", "text", TERMS, False, "source")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("score", "doc_id")))
    return S.representative(t.documents.select("doc_id", "source"), hits, "source", "doc_id", "doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def keyset_page(t: Tables) -> DataFrame:
    return S.page(t.documents.select("doc_id", "lang", "source"), "doc_id", 100, 25)


@query("""SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) AS position, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 60 AS more_available
FROM documents ORDER BY lang, doc_id LIMIT 20 OFFSET 40""")
def offset_page_with_total(t: Tables) -> DataFrame:
    return S.offset_page(t.documents.select("doc_id", "lang"), ["lang", "doc_id"], 40, 20)


@query("""WITH c AS (SELECT doc_id, n_chars FROM documents), r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS running FROM c) SELECT * FROM r WHERE running <= 24000""")
def budget_prefix_pack(t: Tables) -> DataFrame:
    return P.prefix(t.documents.select("doc_id", "n_chars"), [], [F.col("doc_id")], "n_chars", 24_000)


@query("""WITH RECURSIVE r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS direct FROM documents),
p AS (SELECT * FROM r WHERE place <= 120),
w(lang, d, o, k, picked) AS (SELECT lang, coalesce(list(place ORDER BY place) FILTER (direct), []), coalesce(list(place ORDER BY place) FILTER (NOT direct), []), -1, []::BIGINT[] FROM p GROUP BY lang
  UNION ALL SELECT lang, d[n + 1 :], o[10 - n + 1 :], k + 1, list_sort(d[1 : n] || o[1 : 10 - n])
  FROM (SELECT *, least(len(d), greatest(5, 10 - len(o), len([x FOR x IN list_sort(d || o)[1 : 10] IF list_contains(d, x)]))) AS n FROM w WHERE len(d) + len(o) > 0)),
q AS (SELECT lang, unnest(picked) AS place, 10 * k + unnest(range(1, len(picked) + 1)) AS position FROM w WHERE k >= 0)
SELECT lang, doc_id, place, direct, position::BIGINT AS position FROM q JOIN p USING (lang, place)""")
def direct_share_reservation(t: Tables) -> DataFrame:
    """Each language's pool of 120 by size: every ten hold five labelled good while there are any."""
    good = t.labels.where("quality = 1").select("doc_id").distinct().withColumn("direct", F.lit(True))
    rows = t.documents.select("lang", "doc_id", "n_chars").join(good, "doc_id", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    pool = S.top(rows, 120, F.desc("n_chars"), F.col("doc_id"), by=("lang",)).select("lang", "doc_id", F.col("rank").alias("place"), "direct")
    return P.reserve(pool, ["lang"], "place", "direct", 10).select("lang", "doc_id", "place", "direct", "position")


EST = "ceil((length({0}) + length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g'))) / 4)"
@query(f"""WITH g AS (SELECT source AS request, dense_rank() OVER (ORDER BY lang) AS group_place, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place, doc_id, text AS t FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT *, 30 + {EST.format('t')} AS cost FROM g WHERE place <= 20),
b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY request ORDER BY place, group_place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
f AS (SELECT *, 9000 - before AS avail, cost <= 9000 - before AND 9000 - before > 30 AS fits, row_number() OVER (PARTITION BY request ORDER BY place, group_place) AS turn FROM b),
s AS (SELECT *, min(CASE WHEN NOT fits THEN turn END) OVER (PARTITION BY request) AS stop FROM f),
k AS (SELECT *, greatest(avail - 30, 1)::BIGINT AS room FROM s WHERE turn < coalesce(stop, 1e9) OR (turn = stop AND (turn = 1 OR avail >= 110))),
u AS (SELECT request, turn, room, unnest(string_split(left(t, 4 * room), '')) AS ch, unnest(range(least(length(t), 4 * room))) AS i FROM k WHERE NOT fits),
r AS (SELECT request, turn, room, sum(CASE WHEN ch <= chr(127) THEN 1 ELSE 2 END) OVER (PARTITION BY request ORDER BY i) AS run FROM u),
m AS (SELECT request, turn, count(*) FILTER (run <= 4 * room) AS n FROM r GROUP BY request, turn),
x AS (SELECT k.*, coalesce(m.n, length(t)) AS n FROM k LEFT JOIN m USING (request, turn)),
y AS (SELECT *, left(t, n) AS whole, length(left(t, n)) - strpos(reverse(translate(left(t, n), chr(10), ' ')), ' ') AS back FROM x),
z AS (SELECT *, CASE WHEN NOT fits AND strpos(translate(whole, chr(10), ' '), ' ') > 0 AND back > 0.8 * n THEN left(whole, back) ELSE whole END AS content FROM y)
SELECT request, group_place, place, doc_id, turn, md5(content) AS content_md5, NOT fits AS truncated, (30 + {EST.format('content')})::BIGINT AS tokens FROM z WHERE fits OR content <> ''""")
def budget_pack_sources(t: Tables) -> DataFrame:
    """Each source asks for its documents: languages take turns, longest first, within 9,000 tokens."""
    rows = t.documents.where("source is not null and lang is not null")
    langs = rows.select("lang").distinct().withColumn("group_place", F.row_number().over(Window.orderBy("lang")).cast("long"))  # a row a language
    rows = S.top(rows.select("source", "lang", "doc_id", "n_chars", "text"), 20, F.desc("n_chars"), F.col("doc_id"), by=("source", "lang")).join(F.broadcast(langs), "lang")
    packed = P.pack(rows.select(F.col("source").alias("request"), "group_place", F.col("rank").alias("place"), "text", "doc_id"), 9000, 20)
    return packed.select("request", "group_place", "place", "doc_id", "turn", F.md5("content").alias("content_md5"), "truncated", "tokens")


@query("""SELECT conv_id, turn, role, left(text, 120) AS snippet FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 20""")
def capture_search(t: Tables) -> DataFrame:
    return t.conversations.where((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("the"))).orderBy("conv_id", "turn").limit(20).select("conv_id", "turn", "role", F.substring("text", 1, 120).alias("snippet"))


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1') AND lang IN ('en', 'de')")
def scope_filter(t: Tables) -> DataFrame:
    return t.documents.where(F.col("source").startswith("src1") & F.col("lang").isin("en", "de")).select("doc_id", "source")


@query("""WITH e AS (SELECT item_id, text FROM benchmark), x AS (SELECT doc_id, text FROM documents),
p AS (SELECT item_id, doc_id FROM e JOIN x ON contains(x.text, e.text)),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM p),
j AS (SELECT item_id, min(rank) AS best, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall FROM r GROUP BY item_id),
k AS (SELECT unnest(['long', 'total']) AS category, best, recall FROM j)
SELECT category, count(*) AS queries, count(*) FILTER (best = 1) AS hit_at_1, count(*) FILTER (best <= 5) AS hit_at_5, round(avg(recall), 6) AS recall_at_10, round(avg(1.0::DOUBLE / best), 6) AS mrr FROM k GROUP BY category""")
def recall_mrr(t: Tables) -> DataFrame:
    from ..operators import evidence as E

    pairs = E.verbatim(t.benchmark, "item_id", "text", t.documents, "doc_id", "text").select("item_id", "doc_id")
    hits = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    return E.retrieval_metrics(hits, pairs.withColumn("category", F.lit("long")), "item_id", "doc_id", "category")
