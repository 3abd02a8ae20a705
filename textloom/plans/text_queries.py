"""Text functions, chunks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import chunking as C
from ..operators import evidence as E
from ..sources import files
from .registry import Tables, query
from .search_queries import NORM, TOKENS

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""WITH a AS (SELECT item_id, list_distinct({TOKENS.format(NORM.format('text'))}) AS ts FROM benchmark),
k AS (SELECT item_id, ts, list_filter(ts, lambda x: length(x) >= 2 AND x NOT IN ({STOP})) AS c FROM a)
SELECT item_id, array_to_string(list_sort(CASE WHEN len(c) > 0 THEN c ELSE ts END), ' ') AS terms FROM k""")
def content_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(F.array_sort(T.content_terms(F.col("text"))), " ").alias("terms"))


@query(rf"""WITH d AS (SELECT doc_id, {TOKENS.format(NORM.format('text'))} AS ts FROM documents)
SELECT doc_id, array_to_string(list_filter(['thtion', 'er', 'zz'], lambda q: len(list_filter(ts, lambda h: starts_with(h, q) AND (h = q OR starts_with(h, q)))) > 0), ',') AS matched FROM d""")
def matched_tokens(t: Tables) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("thtion", "er", "zz")])
    return t.documents.select("doc_id", F.array_join(T.matched_terms(wanted, T.terms(T.norm(F.col("text")))), ",").alias("matched"))


@query(r"""SELECT item_id, CASE WHEN (length(q) - length(replace(q, '"', ''))) % 2 = 1 THEN replace(q, '"', '') ELSE q END AS cleaned FROM
(SELECT item_id, trim(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), ' +', ' ', 'g')) AS q FROM benchmark)""")
def clean_query(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.clean_query(F.col("text")).alias("cleaned"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), a AS (SELECT doc_id, x, length(regexp_replace(x, '[^\x00-\x7F]', '', 'g')) AS n FROM d)
SELECT doc_id, ceil(n / 4.0::DOUBLE + (length(x) - n) / 2.0::DOUBLE)::BIGINT AS tokens, (ceil(n / 4.0::DOUBLE + (length(x) - n) / 2.0::DOUBLE) <= 500 AND length(x) <= 2000 AND strlen(x) <= 6000) AS fits FROM a""")
def token_estimate(t: Tables) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", T.estimate_tokens(x).alias("tokens"), T.fits_budget(x, 500).alias("fits"))


@query(r"""SELECT doc_id, sha256(text) AS text_sha256, sha256('main' || chr(0) || doc_id::VARCHAR) AS artifact_id,
  'ent:' || substr(sha256('ent' || chr(0) || doc_id::VARCHAR || chr(0) || source), 1, 24) AS entity_id FROM documents""")
def content_addresses(t: Tables) -> DataFrame:
    ref = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", ids.sha(F.col("text")).alias("text_sha256"), ids.artifact_id("main", ref).alias("artifact_id"), ids.entity_id(ref, F.col("source")).alias("entity_id"))


@query(r"""SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text), chr(10) ORDER BY doc_id::VARCHAR || ':' || sha256(text))) AS snapshot FROM documents GROUP BY source""")
def snapshot_hash(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(ids.snapshot_hash(F.col("doc_id").cast("string"), ids.sha(F.col("text"))).alias("snapshot"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::BIGINT AS words, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) >= 100 AS long_enough FROM documents""")
def release_word_counts(t: Tables) -> DataFrame:
    n = F.size(T.terms(F.col("text")))
    return t.documents.select("doc_id", n.cast("long").alias("words"), (n >= 100).alias("long_enough"))


@query(r"""WITH s AS (SELECT doc_id, lang, regexp_replace(text, '\s', '', 'g') AS x FROM documents)
SELECT lang, round(avg(CASE WHEN length(x) = 0 THEN 0.0::DOUBLE ELSE (length(x) - length(regexp_replace(x, '[à-öø-ÿ]', '', 'g')))::DOUBLE / length(x) END), 6) AS share FROM s GROUP BY lang""")
def script_ratio(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.round(F.avg(T.share_of(F.col("text"), "[à-öø-ÿ]")), 6).alias("share"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
m AS (SELECT doc_id, line, x FROM l WHERE contains(x, 'that '))
SELECT doc_id, min(line)::BIGINT AS first_line, count(*) AS lines FROM m GROUP BY doc_id""")
def hit_lines(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.contains("x", F.lit("that ")))
    return lines.groupBy("doc_id").agg((F.min("i") + 1).cast("long").alias("first_line"), F.count("*").alias("lines"))


@query(r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')))::BIGINT AS chars FROM pages""")
def html_text_length(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(T.strip_tags(F.col("html"))).cast("long").alias("chars"))


@query()
def html_to_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", files.html_to_markdown("html").alias("markdown"))


@query()
def mojibake_rows(t: Tables) -> DataFrame:
    return t.documents.where(T.is_mojibake("text")).select("doc_id")


@query()
def normal_forms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.sha(T.normal_form("text")).alias("normal_sha256"))


@query()
def chunk_spans(t: Tables) -> DataFrame:
    version = ids.source_version(F.col("doc_id").cast("string"), "body", F.col("text"))
    c = C.with_refs(C.chunks(t.documents, "doc_id", "text", version), "doc_id")
    return c.select("doc_id", "idx", "start_char", "end_char", F.array_join("heading_path", " / ").alias("heading"), "chunk_ref")


@query("""SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, CASE WHEN coalesce(length(text), 0) <= 4000 THEN least(coalesce(length(text), 0), 1) END::BIGINT AS chunks_if_small, true AS holds FROM documents""")
def chunk_invariants(t: Tables) -> DataFrame:
    return C.invariants(t.documents, C.chunks(t.documents, "doc_id", "text", with_text=False), "doc_id", "text")


@query("""WITH c AS (SELECT conv_id, turn, conv_id || '/' || turn AS ref FROM conversations)
SELECT ref, lag(ref) OVER w AS prev_ref, lead(ref) OVER w AS next_ref, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_neighbors(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    c = t.conversations.select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("ref"))
    c = C.linked(c, "conv_id", "turn", "ref").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    return c.select("ref", "prev_ref", "next_ref", "place")


@query("""SELECT item_id, doc_id, strpos(d.text, b.text)::BIGINT AS at FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 20""")
def verbatim_quote_check(t: Tables) -> DataFrame:
    return E.verbatim(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


def _claims(t: Tables) -> DataFrame:
    """Each item against the document of its number."""
    return t.benchmark.join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("passage")), "item_id").select("item_id", "text", "passage")


@query(rf"""WITH p AS (SELECT b.item_id, list_distinct({TOKENS.format(NORM.format('b.text'))}) AS ts, {TOKENS.format(NORM.format('d.text'))} AS h FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
k AS (SELECT item_id, h, ts, list_filter(ts, lambda x: length(x) >= 2 AND x NOT IN ({STOP})) AS c FROM p),
w AS (SELECT item_id, h, CASE WHEN len(c) > 0 THEN c ELSE ts END AS w FROM k)
SELECT item_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, h))::DOUBLE / len(w) END, 6) AS overlap FROM w""")
def claim_overlap(t: Tables) -> DataFrame:
    return E.claim_support(_claims(t), "item_id", "text", "passage").select("item_id", "overlap")


@query()
def claim_support(t: Tables) -> DataFrame:
    return E.claim_support(_claims(t), "item_id", "text", "passage")


@query("""WITH c AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE left(text, 30) END AS span, item_id * 7 AS ref FROM benchmark)
SELECT item_id, CASE WHEN length(span) = 0 THEN 'NO_SPAN' WHEN d.doc_id IS NULL THEN 'BAD_PASSAGE_REF' WHEN NOT contains(d.text, span) THEN 'SPAN_NOT_FOUND' ELSE 'OK' END AS status
FROM c LEFT JOIN documents d ON d.doc_id = c.ref""")
def citation_status(t: Tables) -> DataFrame:
    c = t.benchmark.select("item_id", F.when(F.col("item_id") % 5 == 0, "").otherwise(F.substring("text", 1, 30)).alias("span"), (F.col("item_id") * 7).alias("ref"))
    return E.citation_status(c, "item_id", "span", "ref", t.documents, "doc_id", "text")


@query(r"""SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'labels' FROM labels UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY kind""")
def jsonl_export_counts(t: Tables) -> DataFrame:
    lines = files.export_json_lines({"documents": t.documents, "labels": t.labels, "benchmark": t.benchmark})
    return lines.groupBy("kind").agg(F.count("*").alias("n"))


@query()
def jsonl_export(t: Tables) -> DataFrame:
    return files.export_json_lines({"labels": t.labels, "nation": t.nation})


@query(r"""SELECT r_regionkey::BIGINT AS id, '{"@id":"urn:' || r_regionkey || '","@type":"Concept","r_name":"' || r_name || '"}' AS line FROM region""")
def json_ld_export(t: Tables) -> DataFrame:
    return files.json_ld(t.region, "r_regionkey", "Concept", "r_name").select(F.col("id").cast("long").alias("id"), "line")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\b(password|token|secret|api[_-]?key)\s*[:=]\s*\S+', '\1=[redacted]', 'g'), '(^|[^\w/:.])/(home|root|Users|var|etc)/\S+', '\1[path]', 'g') AS redacted
FROM documents WHERE regexp_matches(text, '(?i)\b(password|token|secret|api[_-]?key)\s*[:=]')""")
def redacted(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").rlike(r"(?i)\b(password|token|secret|api[_-]?key)\s*[:=]")).select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("""SELECT field, count(*) AS n FROM (SELECT 'lang' AS field, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM documents) WHERE length(v) > 3 GROUP BY field""")
def unpivot_field_check(t: Tables) -> DataFrame:
    from ..operators import census

    return census.unpivot_check(t.documents, "doc_id", ["lang", "source", "n_chars"], lambda v: F.length(v) > 3)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
c AS (SELECT doc_id, sum(CASE WHEN contains(x, 'that ') THEN 2 + (length(x) - length(replace(x, 'that ', ''))) // 5 ELSE 0 END)::BIGINT AS changed FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(changed, 0) AS changed FROM documents LEFT JOIN c USING (doc_id)""")
def changed_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.replace("text", F.lit("that "), F.lit("that\n")).alias("edited"))
    return E.changed_lines(rows, "doc_id", "text", "edited")


@query(r"""WITH d AS (SELECT doc_id, 'a `x` b' || chr(10) || '```py' || chr(10) || text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '```' || chr(10) || 'end `' || lang || '` it' END AS t FROM documents WHERE NOT contains(text, '`') AND lang IS NOT NULL),
f AS (SELECT doc_id, '---' || chr(10) || 'a: ' || source || chr(10) || '---' || chr(10) || text AS t FROM documents WHERE source IS NOT NULL)
SELECT doc_id, 'code' AS kind, md5(regexp_replace(regexp_replace(t, '(?s)```.*?(```|\z)', '', 'g'), '`[^`\n]*`', '', 'g')) AS left_md5 FROM d
UNION ALL SELECT f.doc_id, 'front matter', md5(text) FROM f JOIN documents USING (doc_id)""")
def code_and_front_matter_out(t: Tables) -> DataFrame:
    d = t.documents
    code = F.concat(F.lit("a `x` b\n```py\n"), "text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("```\nend `"), "lang", F.lit("` it"))))
    front = F.concat(F.lit("---\na: "), "source", F.lit("\n---\n"), "text")
    a = d.where(~F.contains("text", F.lit("`")) & F.col("lang").isNotNull()).select("doc_id", F.lit("code").alias("kind"), F.md5(T.strip_code(code)).alias("left_md5"))
    return a.unionByName(d.where("source is not null and text is not null").select("doc_id", F.lit("front matter").alias("kind"), F.md5(T.strip_front_matter(front)).alias("left_md5")))


@query("""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'كتاب ی ' || doc_id || ' ۳٤' ELSE source || doc_id END AS q FROM documents WHERE source IS NOT NULL),
l AS (SELECT doc_id, q, unnest([translate(q, 'كي', 'کی'), translate(q, 'کی', 'كي')]) AS x FROM q),
v AS (SELECT doc_id, q AS v FROM q UNION SELECT doc_id, translate(x, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩0123456789', d || d || d) FROM l, (SELECT unnest(['0123456789', '۰۱۲۳۴۵۶۷۸۹', '٠١٢٣٤٥٦٧٨٩']) AS d))
SELECT doc_id, count(*) AS spellings, md5(string_agg(v, '|' ORDER BY v)) AS all_md5 FROM v GROUP BY doc_id""")
def query_spellings(t: Tables) -> DataFrame:
    """All spellings of mixed Persian and Arabic queries, and of plain ones."""
    q = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("كتاب ی "), "doc_id", F.lit(" ۳٤"))).otherwise(F.concat("source", "doc_id"))
    v = t.documents.where("source is not null").select("doc_id", F.array_sort(T.variants(q)).alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("spellings"), F.md5(F.array_join("v", "|")).alias("all_md5"))


@query("""WITH w AS (SELECT doc_id, (['کتاب', 'دو', 'سنگین', 'شهر'])[doc_id % 4 + 1] || (['', 'ترین', 'های', 'ها', 'ات', 'ان', 'تر', 'ین', 'ی', 'x'])[doc_id % 10 + 1] AS w FROM documents),
s AS (SELECT doc_id, w, list_filter(['ترین', 'های', 'ها', 'ات', 'ان', 'تر', 'ین', 'ی'], lambda x: ends_with(w, x) AND length(w) - length(x) >= 3)[1] AS x FROM w)
SELECT doc_id, w AS term, CASE WHEN x IS NULL THEN w ELSE left(w, length(w) - length(x)) END AS stem FROM s""")
def stemmed_terms(t: Tables) -> DataFrame:
    roots, ends = ["کتاب", "دو", "سنگین", "شهر"], ["", *T.SUFFIXES, "x"]
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % n + 1).cast("int"))
    rows = t.documents.select("doc_id", F.concat(pick(roots, 4), pick(ends, 10)).alias("term"))
    return rows.select("doc_id", "term", T.stem(F.col("term")).alias("stem"))
