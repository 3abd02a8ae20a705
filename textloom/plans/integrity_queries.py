"""Integrity, census, coverage and difference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import census as N
from .registry import Tables, query

TIERS = ["src0", "src1", "src2", "absent"]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_anti_join(t: Tables) -> DataFrame:
    return N.uncovered(t.documents.select("doc_id"), "doc_id", t.labels)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def biconditional_outer(t: Tables) -> DataFrame:
    return N.biconditional(t.labels, t.documents.where("lang = 'en'"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def originals_coverage(t: Tables) -> DataFrame:
    return N.uncovered(t.documents.select("doc_id"), "doc_id", t.labels, t.benchmark.select(F.col("item_id").alias("doc_id")))


@query("SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id > first")
def duplicate_by_hash(t: Tables) -> DataFrame:
    return N.duplicates(t.documents, "doc_id", F.col("text"))


@query("""SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'assistant') AS covered, count(*) = count(*) FILTER (role = 'assistant') AS complete FROM conversations GROUP BY conv_id""")
def coverage_by_source(t: Tables) -> DataFrame:
    return N.coverage(t.conversations, t.conversations.where("role = 'assistant'"), "conv_id", "turn")


@query("""SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 4000) AS long_ones, max(n_chars)::BIGINT AS longest FROM documents GROUP BY lang""")
def status_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 4000).alias("long_ones"), F.max("n_chars").alias("longest"))


@query("""SELECT zone, name, count(*) AS n FROM (SELECT 'lang' AS zone, lang AS name FROM documents UNION ALL SELECT 'role', role FROM conversations UNION ALL SELECT 'quality', quality::VARCHAR FROM labels) GROUP BY zone, name""")
def archive_status(t: Tables) -> DataFrame:
    parts = [(t.documents, "lang", "lang"), (t.conversations, "role", "role"), (t.labels, "quality", "quality")]
    out = None
    for rows, zone, c in parts:
        p = rows.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(zone).alias("zone"), "name", "n")
        out = p if out is None else out.unionByName(p)
    return out


@query("""WITH c AS (SELECT CASE WHEN source IN ('src0', 'src1', 'src2', 'absent') THEN source ELSE 'undeclared' END AS class, count(*) AS n FROM documents GROUP BY 1),
e AS (SELECT unnest(['src0', 'src1', 'src2', 'absent', 'undeclared']) AS class) SELECT e.class, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN c USING (class)""")
def census_by_tier(t: Tables) -> DataFrame:
    return N.counts_with_empty(t.documents, "source", TIERS)


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) > 1")
def repeated_key(t: Tables) -> DataFrame:
    return N.repeated_keys(t.events.where("event_type = 'signup'"), "user_id")


@query("""SELECT conv_id, count(*) AS n, min(turn)::BIGINT AS first, max(turn)::BIGINT AS last FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) - min(turn) + 1 <> count(*)""")
def revision_gaps(t: Tables) -> DataFrame:
    return N.gaps(t.conversations.where("turn % 3 <> 1"), "conv_id", "turn")


SNAP_SQL = """WITH a AS (SELECT doc_id, text AS v FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text || ' more' WHEN doc_id % 10 = 5 THEN upper(lang) ELSE text END AS v FROM documents WHERE doc_id % 10 <> 2),
d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' WHEN starts_with(b.v, a.v) THEN 'appended' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id)
"""


def _snapshots(t: Tables) -> DataFrame:
    """Two states of the documents, made from the table: the second lacks, adds, extends and changes some."""
    a = t.documents.where("doc_id % 10 <> 3").select("doc_id", F.col("text").alias("v"))
    v = F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit(" more"))).when(F.col("doc_id") % 10 == 5, F.upper("lang")).otherwise(F.col("text"))
    return N.diff(a, t.documents.where("doc_id % 10 <> 2").select("doc_id", v.alias("v")), "doc_id", "v")


@query(SNAP_SQL + "SELECT * FROM d")
def snapshot_diff(t: Tables) -> DataFrame:
    return _snapshots(t)


@query(SNAP_SQL + "SELECT count(*) AS total, count(*) FILTER (change <> 'unchanged') AS changed, round(100.0::DOUBLE * count(*) FILTER (change <> 'unchanged') / count(*), 6) AS percent, 100.0 * count(*) FILTER (change <> 'unchanged') / count(*) > 30 AS escalate FROM d")
def change_escalation(t: Tables) -> DataFrame:
    return N.percent_changed(_snapshots(t))


@query("SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0")
def baseline_difference(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source")
    return N.difference(d.select("lang", "source"), d.where("doc_id % 2 = 0").select("lang", "source"))


@query("""WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer), s AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(e.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unknown' ELSE 'repeated' END AS problem FROM e FULL JOIN s ON e.k = s.k WHERE s.k IS NULL OR e.k IS NULL OR n > 1""")
def expected_and_receipts(t: Tables) -> DataFrame:
    return N.expected_and_seen(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


LEGAL = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("purchase", "view")]


@query("""WITH s AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT user_id, from_state, to_state, count(*) AS n FROM s WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('purchase', 'view')) GROUP BY ALL""")
def state_path_audit(t: Tables) -> DataFrame:
    return N.path_audit(t.events, "user_id", ["ts", "event_id"], "event_type", t.spark.createDataFrame(LEGAL, "from_state string, to_state string"))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN NOT coalesce(n_chars >= 200, false) THEN 'too_short' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'language' END,
CASE WHEN NOT coalesce(source <> 'src3', false) THEN 'source' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")
def record_rules(t: Tables) -> DataFrame:
    return N.rule_rows(t.documents, "doc_id", {"too_short": F.col("n_chars") >= 200, "language": F.col("lang").isin("en", "de", "fr"), "source": F.col("source") != "src3"})


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)""")
def orphan_records(t: Tables) -> DataFrame:
    return N.uncovered(t.supplier.select("s_suppkey"), "s_suppkey", t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")))


@query("""SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def current_projection_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id")


@query("""SELECT n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def four_way_join(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount")
    j = li.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT source, running::BIGINT AS running, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 20000""")
def running_size_cap(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.documents.select("source", "doc_id", F.sum("n_chars").over(w).alias("running")).where("running <= 20000")


@query("""WITH m AS (SELECT page_id, html FROM pages) SELECT page_id, length(html)::BIGINT AS chars, contains(html, '<table') AS has_table, (length(html) - length(replace(html, '<p', ''))) // 2 AS paragraphs FROM m""")
def entry_page_markers(t: Tables) -> DataFrame:
    from ..functions import text as T

    return t.pages.select("page_id", F.length("html").cast("long").alias("chars"), F.contains("html", F.lit("<table")).alias("has_table"), T.hit_count(F.col("html"), F.lit("<p")).alias("paragraphs"))


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median FROM events GROUP BY event_type""")
def latency_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.percentile("value", 0.5), 6).alias("median"))
