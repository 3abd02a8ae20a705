"""Annotations, states, chunk sync, reviews and the edges that annotations give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotations as A
from .registry import Tables, query


@query("""SELECT kind, count(*) AS n, CASE WHEN kind IN ('capture-text', 'ingested-file') THEN 'annotate' ELSE 'skip' END AS policy FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'capture-text' WHEN doc_id % 3 = 1 THEN 'ingested-file' ELSE 'record' END AS kind FROM documents) GROUP BY kind""")
def annotation_policy(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "capture-text").when(F.col("doc_id") % 3 == 1, "ingested-file").otherwise("record")
    return t.documents.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).withColumn("policy", A.policy(F.col("kind")))


@query("""WITH s AS (SELECT conv_id, max(turn) AS version FROM conversations GROUP BY 1), a AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN turn END AS version, CASE WHEN turn % 5 = 4 THEN 'rejected' END AS review, text FROM conversations)
SELECT a.conv_id, a.turn FROM a JOIN s USING (conv_id) WHERE length(a.text) > 0 AND a.review IS NULL AND (a.version IS NULL OR a.version = s.version)""")
def usable_annotations(t: Tables) -> DataFrame:
    a = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 != 2, F.col("turn")).alias("version"), F.when(F.col("turn") % 5 == 4, "rejected").alias("review"), "text")
    s = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("version"))
    return A.usable(a, s, "conv_id", "version", "review", "text").select("conv_id", "turn")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN 'v2' END AS version, doc_id % 7 <> 0 AS has_text FROM documents),
a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'v2' ELSE 'v1' END AS v FROM labels), f AS (SELECT item_id * 5 AS doc_id FROM benchmark)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM f) THEN 'failed' WHEN version IS NULL THEN 'registered' WHEN NOT has_text THEN 'no_text' WHEN EXISTS (SELECT 1 FROM a WHERE a.doc_id = s.doc_id AND v = 'v2') THEN 'annotated'
  WHEN doc_id IN (SELECT doc_id FROM a) THEN 'stale' ELSE 'projected' END AS state FROM s""")
def processing_states(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.when(F.col("doc_id") % 11 != 0, "v2").alias("version"), (F.col("doc_id") % 7 != 0).alias("has_text"), F.lit("registered").alias("state"))
    a = t.labels.select("doc_id", F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("version"))
    return A.states(s, t.benchmark.select((F.col("item_id") * 5).alias("doc_id")), a, "doc_id", "version", "has_text", "state")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 4 = 1 AND n > 1 THEN CASE WHEN conv_id % 8 = 1 THEN 'refuse' ELSE 'replace' END WHEN conv_id % 4 = 2 THEN 'refresh' ELSE 'same' END AS action FROM n""")
def chunk_sync(t: Tables) -> DataFrame:
    """Stored turns against the present ones: a conversation in four lacks its later turns, another has other roles."""
    fresh = t.conversations.select("conv_id", "turn", "role")
    stored = fresh.where("conv_id % 4 <> 1 or turn = 0").withColumn("role", F.when(F.col("conv_id") % 4 == 2, F.lit("other")).otherwise(F.col("role")))
    return A.chunk_sync(stored, fresh, fresh.where("conv_id % 8 = 1"), ["conv_id"], "turn", ["role"])


@query("""WITH c AS (SELECT conv_id, max(turn)::BIGINT AS revision FROM conversations GROUP BY 1), r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'maybe' ELSE 'confirmed' END AS decision FROM conversations)
SELECT r.conv_id, r.turn, CASE WHEN decision = 'maybe' OR r.turn < 1 THEN 'bad_arguments' WHEN r.conv_id % 6 = 0 THEN 'not_found' WHEN r.conv_id % 6 = 1 THEN 'stale_source' WHEN c.revision <> r.turn THEN 'conflict' WHEN r.conv_id % 6 = 2 THEN 'stale_source' ELSE 'recorded' END AS outcome,
  NOT (decision = 'maybe' OR r.turn < 1 OR r.conv_id % 6 = 0) AS audited FROM r JOIN c USING (conv_id)""")
def gated_reviews(t: Tables) -> DataFrame:
    c = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("revision"))
    c = c.where("conv_id % 6 <> 0").select("conv_id", "revision", F.when(F.col("conv_id") % 6 == 2, "v2").otherwise("v1").alias("version"), (F.col("conv_id") % 6 == 1).alias("stale"))
    r = t.conversations.select("conv_id", "turn", F.col("turn").alias("revision"), F.when(F.col("turn") % 4 == 3, "maybe").otherwise("confirmed").alias("decision"), F.lit("seen").alias("note"), F.lit("v1").alias("version"))
    return A.reviews(r, c, "conv_id").select("conv_id", "turn", "outcome", "audited")


@query("""WITH c AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT 'a' || conv_id AS src, 'c' || conv_id || '-' || turn AS dst, 'contains' AS kind FROM c UNION ALL SELECT 'c' || conv_id || '-' || turn, 'c' || conv_id || '-' || nx, 'next_chunk' FROM c WHERE nx IS NOT NULL
UNION ALL SELECT 'a' || conv_id, 'd' || conv_id, 'derived_from' FROM c WHERE turn = 0""")
def structural_edges(t: Tables) -> DataFrame:
    art = F.concat(F.lit("a"), F.col("conv_id").cast("string"))
    chunk = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    c = t.conversations.select(art.alias("artifact"), chunk.alias("chunk"), "turn")
    derived = t.conversations.where("turn = 0").select(art.alias("artifact"), F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("text_ref"))
    return A.structural_edges(c, "artifact", "chunk", "turn", derived)


@query("""WITH c AS (SELECT conv_id, turn, 'chk:' || md5(conv_id || '-' || turn) AS chunk FROM conversations)
SELECT 'art:' || conv_id AS src, CASE turn % 5 WHEN 0 THEN 'ent:' || left(md5('e' || turn), 24) WHEN 1 THEN 'rec:x' || turn WHEN 2 THEN 'art:' || conv_id ELSE 'art:' || conv_id END AS dst,
  CASE WHEN turn % 2 = 0 THEN 'about' ELSE 'contradicts' END AS relation, CASE WHEN turn % 2 = 0 THEN 'semantic' ELSE 'reading' END AS kind, chunk AS evidence, turn AS revision
FROM c WHERE turn % 5 <> 4 AND turn % 7 <> 6 AND (turn % 5 <> 3 OR conv_id % 2 = 0)""")
def annotation_edges(t: Tables) -> DataFrame:
    """Links of every turn: to an entity, a record, the source itself, a chunk (of another source in odd conversations) or nothing known."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    chunk = F.concat(F.lit("chk:"), F.md5(F.concat(conv, F.lit("-"), turn)))
    c = t.conversations.select(conv.alias("artifact"), chunk.alias("chunk"))
    own = F.concat(F.lit("cap:"), conv)
    foreign = F.when(F.col("conv_id") % 2 == 0, chunk).otherwise(F.concat(F.lit("chk:"), F.md5(F.concat(F.lit("none"), turn))))
    k = F.col("turn") % 5
    dst = F.when(k == 0, F.concat(F.lit("ent:"), F.substring(F.md5(F.concat(F.lit("e"), turn)), 1, 24))).when(k == 1, F.concat(F.lit("rec:x"), turn)).when(k == 2, own).when(k == 3, foreign).otherwise("?? no reference")
    relation = F.when(F.col("turn") % 7 == 6, "likes").when(F.col("turn") % 2 == 0, "about").otherwise("contradicts")
    src = F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(chunk)
    links = t.conversations.select(conv.alias("artifact"), own.alias("source_ref"), src.alias("src"), dst.alias("dst"), relation.alias("relation"), F.when(F.col("turn") % 2 == 0, chunk).alias("evidence"), F.col("turn").alias("revision"))
    return A.annotation_edges(links, c)
