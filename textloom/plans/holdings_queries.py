"""Holdings, archives, release scope, answers; text helpers of the audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import holdings as H
from .registry import Tables, query

PREFIXES = ["http://shop.example.org/", "src1/"]
_BAD = """b AS (SELECT doc_id FROM documents WHERE coalesce(lang = 'en', false) <> (doc_id IN (SELECT doc_id FROM labels)))"""


def _contradictions(t: Tables) -> DataFrame:
    return H.contradictions(t.documents.select("doc_id", "lang"), "doc_id", "lang", t.labels, "en")


@query(f"""WITH {_BAD} SELECT count(*) AS count, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM b ORDER BY doc_id LIMIT 5)) AS first FROM b""")
def status_contradictions(t: Tables) -> DataFrame:
    return H.summary(_contradictions(t), "doc_id")


@query(f"""WITH {_BAD}, n AS (SELECT (SELECT count(*) FROM b) + (SELECT count(*) FROM documents WHERE source IS NULL) AS findings) SELECT findings, CASE WHEN findings = 0 THEN 'CENSUS CLEAN' ELSE 'CENSUS DRIFT: ' || findings || ' findings' END AS verdict FROM n""")
def census_verdict(t: Tables) -> DataFrame:
    return H.verdict(contradictions=_contradictions(t), undeclared=t.documents.where("source is null").select("doc_id"))


@query("""WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN sha256(text || '.') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2),
j AS (SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, m.doc_id AS a, f.doc_id AS b, m.h AS x, f.h AS y FROM m FULL JOIN f ON m.doc_id = f.doc_id),
p AS (SELECT doc_id, unnest(list_filter([CASE WHEN b IS NULL THEN 'missing' END, CASE WHEN a IS NULL THEN 'unlisted' END, CASE WHEN a = b AND x <> y THEN 'changed' END, CASE WHEN regexp_matches(doc_id::VARCHAR, '7$') THEN 'forbidden' END], lambda v: v IS NOT NULL)) AS problem FROM j)
SELECT doc_id::VARCHAR AS path, problem FROM p""")
def archive_problems(t: Tables) -> DataFrame:
    """A manifest and an archive that lacks, adds and changes some members, made from the documents."""
    path = F.col("doc_id").cast("string").alias("path")
    a = t.documents.where("doc_id % 10 <> 3").select(path, F.sha2("text", 256).alias("h"))
    b = t.documents.where("doc_id % 10 <> 2").select(path, F.sha2(F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return H.archive_problems(a, b, "path", "h", "7$")


@query("""SELECT page_id, starts_with(url, 'http://shop.example.org/') OR url = 'http://shop.example.org' AS ignored, NOT starts_with(url, '02-sources/') AND page_id % 3 <> 1 AS curated FROM pages""")
def release_scope(t: Tables) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "note").when(F.col("page_id") % 3 == 1, "capture").otherwise("claim")
    return t.pages.select("page_id", H.ignored(F.col("url"), PREFIXES).alias("ignored"), H.curated(F.col("url"), kind, F.col("url")).alias("curated"))


@query("""SELECT CASE WHEN lang IS NULL THEN 'unknown' ELSE lang END AS status, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1""")
def capture_status(t: Tables) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: x\nstatus: '"), F.coalesce("lang", F.lit("")), F.lit("' \n---\nstatus: body\n"))
    d = t.documents.select(H.head_status(F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(head, "text"))).alias("status"))
    return d.where("status is not null").groupBy("status").agg(F.count("*").alias("n"))


_PATHS = """p AS (SELECT item_id, 'a/' || item_id || '.md' AS path, item_id % 3 AS c FROM benchmark UNION ALL SELECT item_id, 'b/' || item_id % 7 || '.md', 9 FROM benchmark),
s AS (SELECT item_id, path, CASE WHEN c = 0 THEN 'ok' WHEN c = 1 THEN 'unresolved' ELSE 'phantom' END AS status FROM p)"""


def _phantoms(t: Tables) -> DataFrame:
    """Answers that name a file that is there, was only retrieved, or is neither."""
    n = F.col("item_id").cast("string")
    own = F.concat(F.lit("a/"), n, F.lit(".md"))
    answer = F.concat(F.lit("see ./"), own, F.lit(" and (b\\"), (F.col("item_id") % 7).cast("string"), F.lit(".md), "), own, F.lit(". "))
    a = t.benchmark.select("item_id", F.replace(answer, F.lit("b\\"), F.lit("b/")).alias("answer"))
    return H.phantom_paths(a, "item_id", "answer", t.benchmark.where("item_id % 3 = 0").select(own.alias("path")), t.benchmark.where("item_id % 3 = 1").select("item_id", F.upper(own).alias("path")))


@query(f"WITH {_PATHS} SELECT * FROM s")
def phantom_paths(t: Tables) -> DataFrame:
    return _phantoms(t)


@query(f"""WITH {_PATHS}, c AS (SELECT conv_id, round(avg(CASE WHEN turn % 3 = 0 THEN 1.0::DOUBLE WHEN turn % 3 = 1 THEN 0.5::DOUBLE ELSE 0 END), 3) AS s FROM conversations GROUP BY 1),
m AS (SELECT round(avg(s), 3) AS mean FROM c), q AS (SELECT round(avg((turn % 4 <> 0)::INT), 3) AS precision FROM conversations), h AS (SELECT count(*) FILTER (status = 'phantom') AS phantoms FROM s)
SELECT mean, precision, phantoms, mean >= 0.5 AND precision >= 0.5 AND phantoms = 0 AS passed FROM m, q, h""")
def faithfulness_report(t: Tables) -> DataFrame:
    claims = t.conversations.select("conv_id", F.when(F.col("turn") % 3 == 0, "supported").when(F.col("turn") % 3 == 1, "partial").otherwise("unsupported").alias("support"))
    cited = t.conversations.select("conv_id", F.when(F.col("turn") % 4 != 0, "ok").otherwise("missing").alias("status"))
    return H.faithfulness(claims, cited, _phantoms(t), "conv_id", 0.5, 0.5)


@query(r"""SELECT doc_id, sha256(array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9\x{0600}-\x{06FF}]+'), ' ')) AS seq FROM documents""")
def token_sequences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.letter_runs(F.col("text")), 256).alias("seq"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace('"**' || text || '**" [src-' || item_id || '].', '\[[A-Za-z0-9][A-Za-z0-9_\-]{0,40}\]', ' ', 'g'), '\*\*|__', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || ':;,.…()—–-''"“”«»*') AS quote FROM benchmark""")
def quote_candidates(t: Tables) -> DataFrame:
    x = F.concat(F.lit('"**'), "text", F.lit('**" [src-'), F.col("item_id").cast("string"), F.lit("]."))
    return t.benchmark.select("item_id", T.bare_quote(x).alias("quote"))


@query("""SELECT doc_id, 'x' || chr((19968 + doc_id % 20000)::INT) || '😀' || lang || 'é' AS decoded FROM documents""")
def json_escapes(t: Tables) -> DataFrame:
    code = F.lpad(F.hex(F.lit(19968) + F.col("doc_id") % 20000), 4, "0")
    return t.documents.select("doc_id", T.unescape_json(F.concat(F.lit("x\\u"), code, F.lit("\\ud83d\\uDE00"), "lang", F.lit("\\u00e9"))).alias("decoded"))


@query("""WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS ls, length(left(text, strpos(text, 'the') - 1)) - length(replace(left(text, strpos(text, 'the') - 1), chr(10), '')) AS before FROM documents WHERE contains(text, 'the'))
SELECT doc_id, sha256(left(array_to_string(ls[greatest(before - 45, 0) + 1 : least(before + 45, len(ls))], chr(10)), 4200)) AS around FROM h""")
def hit_windows(t: Tables) -> DataFrame:
    d = t.documents.where(F.contains("text", F.lit("the")))
    line = T.line_of(F.col("text"), F.locate("the", F.col("text")))
    return d.select("doc_id", F.sha2(T.around_line(F.col("text"), line), 256).alias("around"))


@query("""SELECT doc_id, left(text, list_max(list_filter(range(0, 402), lambda i: strlen(left(text, i)) <= 401))) AS content, strlen(text) > 401 AS truncated FROM documents""")
def byte_capped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clip_bytes(F.col("text"), 401).alias("content"), (F.octet_length("text") > 401).alias("truncated"))
