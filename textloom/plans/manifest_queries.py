"""Manifests as hash trees, their differences, and checked appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import appends as A
from ..operators import hash_tree as H
from ..sources.store import shared_path
from .registry import Tables, query

WIDTH = 32


def _leaves(t: Tables, text: str = "text") -> DataFrame:
    return t.documents.select(F.format_string("%012d", "doc_id").alias("path"), F.sha2(text, 256).alias("digest"))


def _level(k: int) -> str:
    return f"l{k} AS (SELECT node // {WIDTH} AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM l{k - 1} GROUP BY ALL)"


@query(f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY path) - 1 AS node, sha256(path || ':' || coalesce(digest, '')) AS hash FROM (SELECT printf('%012d', doc_id) AS path, sha256(text) AS digest FROM documents)),
{', '.join(_level(k) for k in range(1, 7))},
n AS ({' UNION ALL '.join(f"SELECT {k} AS level, count(*) AS n, min(hash) AS hash FROM l{k}" for k in range(7))})
SELECT hash, (SELECT count(*) FROM l0) AS leaves, level::BIGINT AS levels FROM n WHERE n = 1 ORDER BY level LIMIT 1""")
def corpus_manifest_tree(t: Tables) -> DataFrame:
    return H.root(H.tree(_leaves(t), "path", "digest", WIDTH))


@query("""SELECT printf('%012d', doc_id) AS path, CASE WHEN doc_id % 41 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 41 = 0 OR (doc_id % 37 = 0 AND text IS NOT NULL)
UNION ALL SELECT printf('%012d', doc_id) || 'b', 'added' FROM documents WHERE doc_id % 43 = 0""")
def manifest_differences(t: Tables) -> DataFrame:
    """The documents against a later state of theirs: some gone, some changed, some new."""
    before = H.tree(_leaves(t), "path", "digest", WIDTH)
    i = F.col("doc_id")
    path = F.format_string("%012d", "doc_id")
    later = t.documents.where(i % 41 != 0).select(path.alias("path"), F.sha2(F.when(i % 37 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    new = t.documents.where(i % 43 == 0).select(F.concat(path, F.lit("b")).alias("path"), F.lit("x").alias("digest"))
    return H.differing(before, H.tree(later.unionByName(new), "path", "digest", WIDTH), WIDTH)


@query("""WITH r AS (SELECT DISTINCT doc_id, doc_id % 7 <> 2 AND doc_id IN (SELECT doc_id FROM documents) AS held FROM labels),
a AS (SELECT *, CASE WHEN NOT held THEN 'not_found' WHEN doc_id % 5 = 1 THEN 'stale' WHEN doc_id % 3 = 2 THEN 'conflict' ELSE 'stored' END AS first FROM r),
b AS (SELECT *, CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END WHEN doc_id % 4 = 2 THEN 1 ELSE 7 END AS expected, CASE WHEN first = 'stored' THEN 1 ELSE 0 END AS newest FROM a),
c AS (SELECT *, CASE WHEN first = 'stored' AND doc_id % 4 = 0 THEN 'replay' WHEN first = 'stored' AND doc_id % 4 = 1 THEN 'key_conflict' WHEN NOT held THEN 'not_found' WHEN doc_id % 5 = 1 THEN 'stale' WHEN expected <> newest THEN 'conflict' ELSE 'stored' END AS second FROM b)
SELECT 1 AS round, doc_id, first AS outcome, CASE WHEN first = 'stored' THEN 1 END::BIGINT AS revision FROM c UNION ALL SELECT 2, doc_id, second, CASE WHEN second = 'stored' THEN newest + 1 END FROM c""")
def annotation_appends(t: Tables) -> DataFrame:
    """Two rounds of requests for every labelled document: versions that moved, unknown sources, keys used again, revisions that others took."""
    i = F.col("doc_id")
    source = i.cast("string")
    held = t.documents.where(i % 7 != 2).select(source.alias("source"), F.lit("v1").alias("version"))
    asked = t.labels.select("doc_id").distinct()
    request = lambda key, expected, body: asked.select(source.alias("source"), F.when(i % 5 == 1, "v0").otherwise("v1").alias("version"), expected.cast("long").alias("expected"), key.alias("key"), body.alias("body"))
    path = shared_path(t.spark, "annotations")
    first = A.append_annotations(request(F.lit("k"), F.when(i % 3 == 2, 1).otherwise(0), F.lit("a")), held, path)
    old = i % 4 < 2
    second = A.append_annotations(request(F.when(old, "k").otherwise("n"), F.when(old, F.when(i % 3 == 2, 1).otherwise(0)).when(i % 4 == 2, 1).otherwise(7), F.when(i % 4 == 1, "b").otherwise("a")), held, path)
    rows = lambda df, n: df.select(F.lit(n).alias("round"), F.col("source").cast("long").alias("doc_id"), "outcome", "revision")
    return rows(first, 1).unionByName(rows(second, 2))
