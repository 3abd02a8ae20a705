"""The contract's queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, language_id, mixing, neighbours, ngram_jaccard, periodic_runs, quality_classifier, quality_rules, secret_scan, substring_dedup, token_output, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS ls FROM d),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS x FROM w),
m AS (SELECT doc_id, x, length(x) AS n,
        length(x) - length(replace(replace(x, ' ', ''), chr(9), '')) + 1 AS nw,
        length(x) - length(regexp_replace(x, '[|›•·]', '', 'g')) AS bars,
        (length(x) - length(replace(x, '://', ''))) / 3 AS links,
        length(x) - length(regexp_replace(x, '[#*$%&<>]', '', 'g')) AS syms,
        (length(x) - length(replace(x, '!!', ''))) / 2 AS bangs, lower(x) AS s FROM l),
b AS (SELECT doc_id, count(*) AS lines_removed, sum(n) AS chars_lost FROM m
      WHERE syms * 100 > nw * 30 OR (bars * 100 > nw * 20 AND bars >= 2) OR (links * 100 > nw * 30 AND links >= 2) OR bangs * 100 > nw * 50
        OR ends_with(x, '...') OR ends_with(x, '…')
        OR regexp_matches(x, '^[ \t-\r]*([^ \t-\r]+[ \t]+){0,2}[^ \t-\r]*[^ \t-\r.!?:;,"''”»)\]…][ \t-\r]*\z')
        OR contains(s, 'all rights reserved') OR contains(s, 'licensed under') OR contains(s, 'terms of use') OR contains(s, 'terms of service')
        OR contains(s, 'privacy policy') OR contains(s, 'cookie policy') OR contains(s, 'subscribe to our') OR contains(s, 'copyright (c)') OR contains(s, 'skip to content')
        OR contains(s, 'alle rechte vorbehalten') OR contains(s, 'nutzungsbedingungen') OR contains(s, 'zum inhalt springen') OR contains(s, 'conditions d''utilisation') OR contains(s, 'politique de confidentialit')
        OR contains(s, 'aller au contenu') OR contains(s, 'todos los derechos reservados') OR contains(s, 'condiciones de uso') OR contains(s, 'aviso legal') OR contains(s, 'ir al contenido')
      GROUP BY doc_id),
f AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(f.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(t) AS chars,
        coalesce(b.lines_removed, 0)::BIGINT AS lines_removed, coalesce(b.chars_lost, 0)::BIGINT AS chars_lost
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars_lost * 100 <= chars * 50) AS kept,
  lines_removed, chars_lost
FROM r
"""

def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM
  (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
multi AS (SELECT g FROM sh GROUP BY g HAVING count(*) > 1),
s2 AS (SELECT sh.doc_id, g FROM sh JOIN multi USING (g)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s2 a JOIN s2 b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, reach.c FROM reach JOIN e ON e.x = reach.doc_id WHERE reach.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents")).drop("n_repeats")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE r > 1) GROUP BY doc_id),
pos AS (SELECT doc_id, w[j] AS x, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
goner AS (SELECT doc_id, unnest(js) AS j FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s FROM pos ANTI JOIN goner USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(gone.js), 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_token_output(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return token_output.digests(table(spark, sf_dir, "documents"), vocabulary or vocabulary_path())


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)[0]


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's texts, of which a tenth become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", quality_rules.SPACE), ""))
    df = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w"))
    df = df.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.expr("1 + floor((_n - _a) / (3 + _g % 8))"))
    periodic = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[cast(_a + (i - _a) % _p as int)])), ' ')")
    return df.select("doc_id", F.when(F.col("_n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = periodic_runs.find(with_periods(table(spark, sf_dir, "documents")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    df = df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), listed.alias("listed"), "collapsed")
    return df.select(
        "doc_id", "n_runs", F.col("x.s").alias("start"), (-F.col("x.l")).alias("length"), F.col("x.p").alias("period"), F.expr("(1000 * -x.l) div x.p").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS bad,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
      FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM f GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, e.k, h.k, i.k] AS o FROM k a, k b, k e, k h, k i WHERE len(list_distinct([a.k, b.k, e.k, h.k, i.k])) = 5),
s AS (SELECT o, k AS step, o[k] AS own, o[1 : k - 1] AS before FROM o, k),
r AS (SELECT part, o, step, own, n, g, x, fails[own] AS here, len([b FOR b IN before IF fails[b]]) > 0 AS earlier, len([b FOR b IN fails IF b]) = 1 AS single FROM c, s),
z AS (SELECT part, array_to_string([substr('ABCDE', b, 1) FOR b IN o], '') AS filter_order, step, own,
        coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND single), 0)::BIGINT AS unique_fails,
        coalesce(sum(g) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY part, o, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_output": op7_token_output,
    "op8_url_filters": op8_url_filters,
    "op9_secret_scan": op9_secret_scan,
    "op10_source_mixing": op10_source_mixing,
    "op11_multiprobe_neighbours": op11_multiprobe_neighbours,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op3_benchmark_decontamination": OP3_SQL, "op5_ngram_jaccard": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op13_filter_audit": OP13_SQL}
