"""Graph and reconciliation queries over the relational tables and page links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import Tables, query


def _edges(t: Tables) -> DataFrame:
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return G.edges(
        (t.nation, k("n", "n_nationkey"), k("r", "n_regionkey"), "in_region"), (t.customer, k("c", "c_custkey"), k("n", "c_nationkey"), "in_nation"),
        (t.supplier, k("s", "s_suppkey"), k("n", "s_nationkey"), "in_nation"), (t.orders, k("o", "o_orderkey"), k("c", "o_custkey"), "ordered_by"),
    )


EDGES = """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS kind FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'ordered_by' FROM orders),
b AS (SELECT src, dst, kind, 'out' AS dir FROM e UNION ALL SELECT dst, src, kind, 'in' FROM e)"""


@query(EDGES + " SELECT kind, count(*) AS n, count(DISTINCT dst) AS targets FROM e GROUP BY kind")
def fk_graph_edges(t: Tables) -> DataFrame:
    return _edges(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"))


@query(EDGES + " SELECT DISTINCT src AS node, dst AS other, kind, dir FROM b WHERE src IN ('n3', 'c10')")
def graph_neighbors(t: Tables) -> DataFrame:
    return G.neighbors(_edges(t), ["n3", "c10"])


@query(EDGES + """, h(node, depth) AS (SELECT 's1', 0 UNION SELECT b.dst, h.depth + 1 FROM h JOIN b ON b.src = h.node WHERE h.depth < 3)
SELECT node, min(depth)::BIGINT AS depth FROM h GROUP BY node""")
def graph_khop(t: Tables) -> DataFrame:
    return G.k_hop(_edges(t), t.spark.createDataFrame([("s1",)], "node string"), 3)


@query(EDGES + " SELECT src AS node, count(*) AS degree FROM b GROUP BY src HAVING count(*) > 24")
def graph_hub_guard(t: Tables) -> DataFrame:
    return G.degrees(_edges(t)).where(F.col("degree") > G.HUB_DEGREE)


@query()
def graph_bfs_bounded(t: Tables) -> DataFrame:
    return G.expand(_edges(t), ["c1", "n2", "s3"])


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"#]*)', 1)) AS target FROM pages)
SELECT h.page_id, h.target FROM h WHERE target NOT IN (SELECT url FROM pages)""")
def dangling_links(t: Tables) -> DataFrame:
    e = G.hrefs(t.pages, "page_id", "html").select("page_id", F.col("target").alias("dst"))
    return G.dangling(e, t.pages.select(F.col("url").alias("node"))).select("page_id", F.col("dst").alias("target"))


@query("""WITH names AS (SELECT page_id AS id, url, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages),
u AS (SELECT url, min(id) AS r FROM names GROUP BY url HAVING count(DISTINCT id) = 1), o AS (SELECT host, min(id) AS r FROM names GROUP BY host HAVING count(DISTINCT id) = 1),
x AS (SELECT page_id, url AS target FROM pages UNION ALL SELECT page_id, regexp_extract(url, '://([^/]+)', 1) FROM pages)
SELECT page_id, target, coalesce(u.r, o.r) AS resolved_id FROM x LEFT JOIN u ON target = u.url LEFT JOIN o ON target = o.host""")
def link_resolution(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "://([^/]+)", 1)
    names = t.pages.select(F.col("page_id").alias("id"), "url", host.alias("host"))
    targets = t.pages.select("page_id", F.col("url").alias("target")).unionByName(t.pages.select("page_id", host.alias("target")))
    return G.resolve(targets, "target", names, "url", "host").select("page_id", "target", "resolved_id")


@query(EDGES + """, n AS (SELECT 'p' || p_partkey AS node FROM part UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)
SELECT node FROM n WHERE node NOT IN (SELECT dst FROM e)""")
def inbound_orphans(t: Tables) -> DataFrame:
    k = lambda rows, p, c: rows.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("node"))
    nodes = k(t.part, "p", "p_partkey").unionByName(k(t.nation, "n", "n_nationkey")).unionByName(k(t.region, "r", "r_regionkey"))
    return G.orphans(nodes, _edges(t))


@query(EDGES + """, h(node, depth) AS (SELECT 'c5', 0 UNION SELECT b.dst, h.depth + 1 FROM h JOIN b ON b.src = h.node WHERE h.depth < 2), d AS (SELECT node, min(depth) AS depth FROM h GROUP BY node)
SELECT CASE left(node, 1) WHEN 'c' THEN 'customers' WHEN 'o' THEN 'orders' WHEN 'n' THEN 'nations' WHEN 's' THEN 'suppliers' ELSE 'regions' END AS section, node, depth::BIGINT AS depth,
  row_number() OVER (ORDER BY left(node, 1), depth, node) AS position FROM d""")
def reconcile_sections(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    d = G.k_hop(_edges(t), t.spark.createDataFrame([("c5",)], "node string"), 2)
    lead = F.substring("node", 1, 1)
    section = F.when(lead == "c", "customers").when(lead == "o", "orders").when(lead == "n", "nations").when(lead == "s", "suppliers").otherwise("regions")
    return d.select(section.alias("section"), "node", "depth", F.row_number().over(Window.orderBy(lead, "depth", "node")).cast("long").alias("position"))
