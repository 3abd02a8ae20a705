"""Versions, queues, generations and batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import census, versioning as V
from .registry import Tables, query


def _versions(t: Tables) -> DataFrame:
    """Every third document has two known versions, of which the second is current."""
    d = t.documents.where("doc_id % 4 <> 0")
    v1 = d.select("doc_id", F.lit("v1").alias("version"), (F.col("doc_id") % 3 != 0).alias("is_current"))
    return v1.unionByName(d.where("doc_id % 3 = 0").select("doc_id", F.lit("v2").alias("version"), F.lit(True).alias("is_current")))


@query("""WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0), cur AS (SELECT doc_id, 'v1' AS version, doc_id % 3 <> 0 AS c FROM d UNION ALL SELECT doc_id, 'v2', true FROM d WHERE doc_id % 3 = 0),
i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'v3' ELSE 'v1' END AS version FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, version AS now FROM cur WHERE c)
SELECT coalesce(i.doc_id, n.doc_id) AS doc_id, coalesce(i.version, n.now) AS version,
  CASE WHEN i.version IS NULL THEN 'missing' WHEN n.now IS NULL THEN 'created' WHEN i.version = n.now THEN 'unchanged' WHEN EXISTS (SELECT 1 FROM cur k WHERE k.doc_id = i.doc_id AND k.version = i.version) THEN 'reactivated' ELSE 'new_version' END AS action
FROM i FULL JOIN n ON i.doc_id = n.doc_id""")
def upsert_actions(t: Tables) -> DataFrame:
    incoming = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "v3").otherwise("v1").alias("version"))
    return V.upsert(_versions(t), incoming, "doc_id", "version")


REV_SQL = """WITH r AS (SELECT conv_id, turn AS revision, turn % 4 = 3 AS rejected, turn % 3 = 1 AS complete, CASE WHEN turn % 2 = 0 THEN role END AS a, CASE WHEN turn % 3 <> 0 THEN left(text, 10) END AS b FROM conversations)"""


@query(REV_SQL + """, l AS (SELECT * FROM r WHERE NOT rejected), k AS (SELECT conv_id, max(CASE WHEN complete THEN revision END) AS base FROM l GROUP BY conv_id),
w AS (SELECT l.* FROM l JOIN k USING (conv_id) WHERE base IS NULL OR revision >= base)
SELECT conv_id, max(revision)::BIGINT AS revision, arg_max(a, revision) FILTER (a IS NOT NULL) AS a, arg_max(b, revision) FILTER (b IS NOT NULL) AS b FROM w GROUP BY conv_id""")
def effective_window(t: Tables) -> DataFrame:
    r = t.conversations.select("conv_id", F.col("turn").alias("revision"), (F.col("turn") % 4 == 3).alias("rejected"), (F.col("turn") % 3 == 1).alias("complete"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("a"), F.when(F.col("turn") % 3 != 0, F.substring("text", 1, 10)).alias("b"))
    return V.effective(r, "conv_id", ["a", "b"])


@query("""WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) SELECT c_custkey, coalesce(s, 'unreviewed') AS state FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def latest_review(t: Tables) -> DataFrame:
    reviews = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return V.latest_review(t.customer, reviews, "c_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH c AS (SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'assistant') AS covered FROM conversations GROUP BY 1), l AS (SELECT conv_id, max(turn) AS touched FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, total, covered, touched, row_number() OVER (ORDER BY touched NULLS FIRST, conv_id) AS position FROM c LEFT JOIN l USING (conv_id) WHERE total <> covered""")
def work_queue(t: Tables) -> DataFrame:
    done = t.conversations.where("role = 'assistant'")
    cover = census.coverage(t.conversations, done, "conv_id", "turn")
    return V.work_queue(cover, done.groupBy("conv_id").agg(F.max("turn").alias("touched")), "conv_id", "touched").drop("complete")


def _generations(t: Tables) -> DataFrame:
    first = t.documents.select("doc_id", "lang", F.lit(1).cast("long").alias("gen_from"), F.lit(None).cast("long").alias("gen_to"))
    fresh = t.documents.where("doc_id % 10 = 0").select("doc_id", F.upper("lang").alias("lang"))
    return V.next_generation(first, fresh, "doc_id", 2)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def generation_visible(t: Tables) -> DataFrame:
    return V.visible(_generations(t), 2).select("doc_id", "lang")


@query("SELECT gen_from, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS gen_from FROM documents) GROUP BY 1")
def generation_compact(t: Tables) -> DataFrame:
    return V.compact(_generations(t), 2).groupBy("gen_from").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT doc_id, md5(lang) AS f FROM documents WHERE doc_id % 9 <> 0), c AS (SELECT doc_id, md5(CASE WHEN doc_id % 8 = 0 THEN source ELSE lang END) AS f FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(i.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'remove' WHEN i.doc_id IS NULL THEN 'build' ELSE 'rebuild' END AS action FROM i FULL JOIN c ON i.doc_id = c.doc_id WHERE c.doc_id IS NULL OR i.doc_id IS NULL OR i.f <> c.f""")
def index_refresh_plan(t: Tables) -> DataFrame:
    i = t.documents.where("doc_id % 9 <> 0").select("doc_id", F.md5(F.encode("lang", "UTF-8")).alias("f"))
    c = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.encode(F.when(F.col("doc_id") % 8 == 0, F.col("source")).otherwise(F.col("lang")), "UTF-8")).alias("f"))
    return V.dirty(i, c, "doc_id", "f")


@query("""SELECT user_id, count(*) AS attempts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) < 2 AND epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts))) >= 300 AS retry_due FROM events WHERE event_type = 'error' GROUP BY user_id""")
def failure_backoff(t: Tables) -> DataFrame:
    log = t.events.where("event_type = 'error'")
    out = V.failures(log, "user_id", "ts", F.lit("2030-01-01").cast("timestamp"))
    return out.withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH c AS (SELECT DISTINCT user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM events)
SELECT user_id, CASE WHEN (s, w) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase')) THEN w ELSE s END AS state, (s, w) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase')) AS accepted FROM c""")
def state_transition(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max_by("event_type", F.struct("ts", "event_id")).alias("to"))
    legal = t.spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase")], "from_state string, to_state string")
    return V.transition(g.select("user_id", "state"), g.select("user_id", "to"), "user_id", legal)


@query("""SELECT event_id, outcome FROM (SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'stored' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id))""")
def idempotent_requests(t: Tables) -> DataFrame:
    log = t.events.select("event_id", "event_type", F.concat_ws("/", "user_id", F.date_format("ts", "yyyyMMdd")).alias("k"))
    return V.by_request(log, "k", "event_id", "event_type").select("event_id", "outcome")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 12 AS run FROM supplier),
g AS (SELECT s_nationkey, run, count(*) AS n FROM p GROUP BY s_nationkey, run), r AS (SELECT *, row_number() OVER (ORDER BY s_nationkey, run) AS k FROM g),
b AS (SELECT s_nationkey, run, sum(CASE WHEN n >= 8 OR k = 1 THEN 1 ELSE 0 END) OVER (ORDER BY k) - 1 AS batch FROM r)
SELECT s_suppkey, s_nationkey, batch::BIGINT AS batch FROM p JOIN b USING (s_nationkey, run)""")
def batch_plan(t: Tables) -> DataFrame:
    return V.plan_batches(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"])


@query("""SELECT doc_id, source, lang, CASE source WHEN 'src1' THEN 'primary' WHEN 'src2' THEN 'secondary' ELSE 'derivative' END AS new_tier FROM documents WHERE lang IS DISTINCT FROM CASE source WHEN 'src1' THEN 'primary' WHEN 'src2' THEN 'secondary' ELSE 'derivative' END""")
def retier_plan(t: Tables) -> DataFrame:
    return V.retier(t.documents.select("doc_id", "source", "lang"), "source", "lang", {"src1": "primary", "src2": "secondary"}, "derivative")
