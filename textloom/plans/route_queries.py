"""Graph route: bounded expansions of all benchmark items at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import graph_route as R
from .graph_queries import EDGES, _edges
from .registry import Tables, query

ITEM_SEEDS = """seeds AS (SELECT item_id AS request, unnest([1, 2, 3]) AS place, unnest(['c' || (item_id * 37 % 100 + 1), 'n' || (item_id % 25), 's' || (item_id % 7 + 1)]) AS node FROM benchmark)"""


def _item_seeds(t: Tables) -> DataFrame:
    i = F.col("item_id")
    nodes = F.array(F.concat(F.lit("c"), i * 37 % 100 + 1), F.concat(F.lit("n"), i % 25), F.concat(F.lit("s"), i % 7 + 1))
    return t.benchmark.select(i.alias("request"), F.posexplode(nodes).alias("place", "node")).withColumn("place", F.col("place") + 1)


def expansion_sql(edges: str, seeds: str, b: R.Bounds = R.Bounds()) -> str:
    """DuckDB's expansion of two steps; edges: a CTE list with b(src, dst, kind, dir), seeds: one with (request, place, node)."""
    assert b.depth == 2

    def level(d: int, before: str) -> str:
        opens = "true" if d == 1 else f"degree <= {b.hub}"
        return f""",
c{d} AS (SELECT f.request, {d} AS depth, f.place AS fp, a.place AS ep, f.node AS last, a.other AS node, f.seed, list_append(f.via, f.node || ' ' || a.kind || ' ' || a.dir || ' ' || a.other) AS via
  FROM v{d - 1} f JOIN adj a USING (node) WHERE a.place <= {b.fan_out} AND {opens}),
g{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, node ORDER BY fp, ep) AS k FROM c{d} ANTI JOIN ({before}) USING (request, node)) WHERE k = 1),
h{d} AS (SELECT request, count(*) AS held FROM ({before}) GROUP BY request),
x{d} AS (SELECT g{d}.*, held + row_number() OVER (PARTITION BY request ORDER BY fp, ep) AS place FROM g{d} JOIN h{d} USING (request)),
v{d} AS (SELECT request, node, depth, place, seed, via, last FROM x{d} WHERE place <= {b.nodes})"""

    v0 = "SELECT request, node FROM v0"
    return f"""{edges}, {seeds},
adj AS (SELECT src AS node, dst AS other, kind, dir, row_number() OVER (PARTITION BY src ORDER BY kind, dst, dir) AS place, count(*) OVER (PARTITION BY src) AS degree FROM b),
deg AS (SELECT DISTINCT node, degree FROM adj),
s AS (SELECT request, node, min(place) AS p FROM seeds GROUP BY request, node),
v0 AS (SELECT * FROM (SELECT request, node, 0 AS depth, row_number() OVER (PARTITION BY request ORDER BY p, node) AS place, node AS seed, []::VARCHAR[] AS via, NULL AS last FROM s) WHERE place <= {b.seeds}){level(1, v0)}{level(2, v0 + ' UNION ALL SELECT request, node FROM v1')},
v AS (FROM v0 UNION ALL FROM v1 UNION ALL FROM v2),
w AS (SELECT request, depth, fp, ep, last, node, via FROM c1 UNION ALL SELECT request, depth, fp, ep, last, node, via FROM c2),
o AS (SELECT request, node, array_to_string(via, '; ') AS way, row_number() OVER (PARTITION BY request, node ORDER BY w.depth, fp, ep) AS k
  FROM w JOIN (SELECT request, node, last AS prev FROM v WHERE depth > 0) USING (request, node) WHERE last <> prev),
t AS (SELECT request, node, string_agg(way, ' | ' ORDER BY k) AS also_via FROM o WHERE k <= {b.other_ways} GROUP BY request, node),
z AS (SELECT DISTINCT request, true AS over FROM (SELECT request, place FROM x1 UNION ALL SELECT request, place FROM x2) WHERE place > {b.nodes})"""


EXPANDED = """
SELECT v.request, v.node, v.depth::BIGINT AS depth, v.place, v.seed, array_to_string(v.via, '; ') AS via, coalesce(t.also_via, '') AS also_via,
  (v.depth = 1 AND coalesce(degree, 0) > 24) AS leaf, (v.depth < 2 AND NOT (v.depth = 1 AND coalesce(degree, 0) > 24) AND coalesce(degree, 0) > 10) AS capped, coalesce(over, false) AS truncated
FROM v LEFT JOIN t USING (request, node) LEFT JOIN deg USING (node) LEFT JOIN z USING (request)"""


def _written(visits: DataFrame) -> DataFrame:
    way = lambda steps: F.array_join(F.transform(steps, lambda s: F.concat_ws(" ", s["src"], s["kind"], s["dir"], s["dst"])), "; ")
    return visits.withColumns({"via": way(F.col("via")), "also_via": F.array_join(F.transform("also_via", way), " | ")})


@query(expansion_sql(EDGES, ITEM_SEEDS) + EXPANDED)
def graph_expansion_items(t: Tables) -> DataFrame:
    return _written(R.expand(_edges(t), _item_seeds(t)))


DOCUMENT_EDGES = """WITH first AS (SELECT text, min(doc_id) AS root FROM documents WHERE text IS NOT NULL GROUP BY text),
quoted AS (SELECT item_id, doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)),
e AS (SELECT 'd' || doc_id AS src, 's' || source AS dst, 'from' AS kind FROM documents UNION ALL SELECT 'd' || doc_id, 'd' || root, 'copies' FROM documents JOIN first USING (text) WHERE root < doc_id
UNION ALL SELECT 'd' || doc_id, 'i' || item_id, 'quotes' FROM quoted),
b AS (SELECT src, dst, kind, 'out' AS dir FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst, src, kind, 'in' FROM e WHERE dst IS NOT NULL)"""


@query(expansion_sql(DOCUMENT_EDGES, "seeds AS (SELECT item_id AS request, 1 AS place, 'i' || item_id AS node FROM benchmark)") + """,
h AS (SELECT v.request, d.lang AS "group", v.place, v.node, d.doc_id, v.seed, v.via FROM v JOIN documents d ON v.node = 'd' || d.doc_id WHERE depth > 0)
SELECT request, "group", row_number() OVER (PARTITION BY request, "group" ORDER BY place) AS rank, node, doc_id AS part, seed, len(via)::BIGINT AS steps FROM h""")
def graph_route_items(t: Tables) -> DataFrame:
    """Documents that the graph leads to from each benchmark item: those that quote it, and their copies."""
    from ..operators import evidence as E

    d, node = t.documents, lambda p, c: F.concat(F.lit(p), F.col(c))
    first = d.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("root"))
    copies = d.select("doc_id", "text").join(first, "text").where("root < doc_id")
    quoted = E.verbatim(t.benchmark, "item_id", "text", d, "doc_id", "text")
    e = G.edges((d, node("d", "doc_id"), node("s", "source"), "from"), (copies, node("d", "doc_id"), node("d", "root"), "copies"), (quoted, node("d", "doc_id"), node("i", "item_id"), "quotes"))
    seeds = t.benchmark.select(F.col("item_id").alias("request"), F.lit(1).alias("place"), node("i", "item_id").alias("node"))
    holders = d.select(node("d", "doc_id").alias("node"), F.col("lang").alias("group"), F.col("doc_id").alias("part"))
    hits = R.route_hits(R.expand(e, seeds), holders)
    return hits.select("request", "group", "rank", "node", "part", "seed", F.size("matched").cast("long").alias("steps"))


ANSWER_SQL = expansion_sql(DOCUMENT_EDGES.replace("WITH ", "WITH RECURSIVE ", 1), "seeds AS (SELECT item_id AS request, 1 AS place, 'i' || item_id AS node FROM benchmark)") + """,
gh AS (SELECT v.request, d.lang AS grp, d.doc_id AS key, d.source, row_number() OVER (PARTITION BY v.request, d.lang ORDER BY v.place) AS r_graph FROM v JOIN documents d ON v.node = 'd' || d.doc_id WHERE depth > 0),
th AS (SELECT item_id AS request, d.lang AS grp, doc_id AS key, d.source, row_number() OVER (PARTITION BY item_id, d.lang ORDER BY d.n_chars, doc_id) AS r_text FROM quoted JOIN documents d USING (doc_id)),
cn AS (SELECT request, grp, key, coalesce(gh.source, th.source) AS source, r_text, r_graph FROM gh FULL JOIN th USING (request, grp, key)),
rk AS (SELECT *, r_text IS NOT NULL AS is_direct, CASE WHEN r_text IS NOT NULL THEN row_number() OVER (PARTITION BY request, grp ORDER BY r_text NULLS LAST, key) END AS d, CASE WHEN r_graph IS NOT NULL THEN row_number() OVER (PARTITION BY request, grp ORDER BY r_graph NULLS LAST, key) END AS g FROM cn),
sc AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + g), 0), 12) AS score FROM rk),
cp AS (SELECT *, row_number() OVER (PARTITION BY request, grp, source ORDER BY score DESC, is_direct DESC, d NULLS LAST, key) AS s FROM sc),
pl AS (SELECT *, row_number() OVER (PARTITION BY request, grp ORDER BY score DESC, is_direct DESC, d NULLS LAST, key) AS place FROM cp WHERE s <= 3),
rw(request, grp, ds, os, k, picked) AS (SELECT request, grp, coalesce(list(place ORDER BY place) FILTER (is_direct), []), coalesce(list(place ORDER BY place) FILTER (NOT is_direct), []), -1, []::BIGINT[] FROM pl GROUP BY request, grp
  UNION ALL SELECT request, grp, ds[n + 1 :], os[4 - n + 1 :], k + 1, list_sort(ds[1 : n] || os[1 : 4 - n])
  FROM (SELECT *, least(len(ds), greatest(2, 4 - len(os), len([x FOR x IN list_sort(ds || os)[1 : 4] IF list_contains(ds, x)]))) AS n FROM rw WHERE len(ds) + len(os) > 0)),
rp AS (SELECT request, grp, unnest(picked) AS place, 4 * k + unnest(range(1, len(picked) + 1)) AS position FROM rw WHERE k >= 0),
ps AS (SELECT p.*, rp.position, count(*) OVER (PARTITION BY request, grp) AS all_, dense_rank() OVER (PARTITION BY request ORDER BY grp) AS gp, d.text AS t FROM pl p JOIN rp USING (request, grp, place) JOIN documents d ON d.doc_id = p.key),
co AS (SELECT *, 30 + ceil((length(t) + length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))) / 4) AS cost FROM ps WHERE position <= 5),
bf AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY request ORDER BY position, gp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY request ORDER BY position, gp) AS turn FROM co),
ft AS (SELECT *, cost <= 1500 - before AND 1500 - before > 30 AS fits FROM bf),
st AS (SELECT *, min(CASE WHEN NOT fits THEN turn END) OVER (PARTITION BY request) AS stop FROM ft),
kp AS (SELECT * FROM st WHERE turn < coalesce(stop, 1e9) OR (turn = stop AND (turn = 1 OR 1500 - before >= 110)))
SELECT request, grp AS "group", key, position, score, is_direct, turn, NOT fits AS truncated, all_ > max(position) OVER (PARTITION BY request, grp) AS more FROM kp"""


@query(ANSWER_SQL)
def answers_of_items(t: Tables) -> DataFrame:
    """Whole answers for every benchmark item: documents that quote it and what the graph leads to, fused, shared out by language, within 1,500 tokens."""
    from ..operators import evidence as E
    from ..operators import packing as P

    d, node = t.documents, lambda p, c: F.concat(F.lit(p), F.col(c))
    first = d.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("root"))
    copies = d.select("doc_id", "text").join(first, "text").where("root < doc_id")
    quoted = E.verbatim(t.benchmark, "item_id", "text", d, "doc_id", "text").select("item_id", "doc_id")
    e = G.edges((d, node("d", "doc_id"), node("s", "source"), "from"), (copies, node("d", "doc_id"), node("d", "root"), "copies"), (quoted, node("d", "doc_id"), node("i", "item_id"), "quotes"))
    seeds = t.benchmark.select(F.col("item_id").alias("request"), F.lit(1).alias("place"), node("i", "item_id").alias("node"))
    graph = R.route_hits(R.expand(e, seeds), d.select(node("d", "doc_id").alias("node"), F.col("lang").alias("group"), F.col("doc_id").alias("part"))).select("request", "group", F.col("part").alias("key"), F.col("rank").alias("r_graph"))
    from pyspark.sql import Window

    by_size = Window.partitionBy("item_id", "lang").orderBy("n_chars", "doc_id")
    text = quoted.join(d.select("doc_id", "lang", "n_chars"), "doc_id").select(F.col("item_id").alias("request"), F.col("lang").alias("group"), F.col("doc_id").alias("key"), F.row_number().over(by_size).cast("long").alias("r_text"))
    candidates = graph.join(text, ["request", "group", "key"], "full_outer").join(d.select(F.col("doc_id").alias("key"), "source"), "key")
    out = P.answer(candidates, d.select(F.col("doc_id").alias("key"), "text"), ["r_text"], 1500, 5, 4)
    return out.select("request", "group", "key", "position", "score", "is_direct", "turn", "truncated", "more")


PAGES_SQL = r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"#]*)', 1)) AS target FROM pages), u AS (SELECT url, min('p' || page_id) AS p FROM pages WHERE url IS NOT NULL GROUP BY url),
e AS (SELECT DISTINCT 'p' || page_id AS src, coalesce(p, target) AS dst FROM h LEFT JOIN u ON url = target), x AS (SELECT * FROM e WHERE src <> dst)
SELECT src AS node, dst AS other, 'out' AS dir FROM x UNION ALL SELECT dst, src, 'in' FROM x"""


@query(PAGES_SQL)
def page_neighbors(t: Tables) -> DataFrame:
    """Links between pages, where a url that is a page's own is that page."""
    page = F.concat(F.lit("p"), "page_id")
    links = G.hrefs(t.pages.select(page.alias("src"), "html"), "src", "html").select("src", F.col("target").alias("dst"), F.lit("links").alias("kind"))
    e = G.canonical(links, t.pages.where("url is not null").select(F.col("url").alias("ref"), page.alias("node")))
    return G.both_ways(e).select(F.col("src").alias("node"), F.col("dst").alias("other"), "dir")


@query("""WITH r AS (SELECT conv_id, 'c' || conv_id || '/' || turn AS ref FROM conversations UNION ALL SELECT DISTINCT conv_id, 'c' || conv_id FROM conversations UNION ALL SELECT DISTINCT conv_id, 'x' || conv_id FROM conversations)
SELECT ref, CASE WHEN ref NOT LIKE 'x%' THEN conv_id END AS owner FROM r""")
def text_ref_owners(t: Tables) -> DataFrame:
    """Turns belong to their conversation, which also has a name of its own."""
    name = F.concat(F.lit("c"), "conv_id")
    turns = t.conversations.select("conv_id", F.concat(name, F.lit("/"), "turn").alias("ref"))
    holders = turns.groupBy(F.col("conv_id").alias("node")).agg(F.first(F.concat(F.lit("c"), F.col("conv_id"))).alias("ref"), F.collect_list("ref").alias("layers"))
    ids = t.conversations.select("conv_id").distinct()
    refs = turns.select("ref").unionByName(ids.select(name.alias("ref"))).unionByName(ids.select(F.concat(F.lit("x"), "conv_id").alias("ref")))
    return G.owners(refs, holders)


@query(r"""WITH a AS (SELECT doc_id, md5(text) AS version, n_chars FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
l AS (SELECT doc_id AS source, 0 AS k, 0 AS pos, '{"chars":' || n_chars || ',"source":' || doc_id || ',"type":"artifact","version":"' || version || '"}' AS line FROM a
  UNION ALL SELECT doc_id, 1, p, '{"at":' || p || ',"end":' || least(p + 4000, n_chars) || ',"source":' || doc_id || ',"type":"part"}' FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars, 1), 4000)) AS p FROM a)
  UNION ALL SELECT doc_id, 2, 1, '{"quality":' || quality || ',"revision":1,"source":' || doc_id || ',"type":"note"}' FROM n SEMI JOIN a USING (doc_id))
SELECT source, row_number() OVER (PARTITION BY source ORDER BY k, pos) AS place, line FROM l UNION ALL SELECT NULL, 0, '{"schema":"1","scope":"current-state","type":"header"}'""")
def state_export(t: Tables) -> DataFrame:
    from ..sources import files

    d = t.documents.where("text is not null").select(F.col("doc_id").alias("source"), "text", "n_chars")
    artifacts = d.select("source", F.md5("text").alias("version"), F.col("n_chars").alias("chars"))
    starts = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest("n_chars", F.lit(1)).cast("long"), F.lit(4000).cast("long")), lambda p: p < F.greatest("n_chars", F.lit(1)))
    parts = d.select("source", "n_chars", F.explode(starts).alias("at")).select("source", "at", F.least(F.col("at") + 4000, F.col("n_chars")).alias("end"))
    notes = t.labels.groupBy(F.col("doc_id").alias("source")).agg(F.max("quality").alias("quality")).withColumn("revision", F.lit(1))
    return files.state_lines(artifacts, parts, notes, {"schema": "1", "scope": "current-state"})
