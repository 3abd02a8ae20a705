"""Capture records and proposals built from documents, judged by their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import captures as C
from ..operators import sections as S
from .registry import Tables, query

_ROWS = "text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL"


def _id() -> Column:
    return F.format_string("cap-20240101-000000-%04x", (F.col("doc_id") % 65536))


def _record() -> Column:
    """By doc_id % 9: good text, wrong hash, a field and a section missing, an illegal step, media that is not there, a status that is not the path's, bad words, good media, no front matter."""
    i = F.col("doc_id")
    case = i % 9
    media = case.isin(4, 7)
    body = F.concat("text", F.lit("\n"))
    value = lambda n, v: F.concat(F.lit(f"{n}: "), v, F.lit("\n"))
    text = lambda v: F.lit(v)
    fields = {
        "id": _id(), "type": text("capture"), "title": F.concat(F.lit('"of '), F.col("source"), F.lit('"')), "status": F.when(case == 5, "parked").when(case == 3, "promoted").otherwise("processing"), "capture_kind": F.when(case == 6, "dream").when(media, "voice").otherwise("text"),
        "captured_at": text("2024-01-01T00:00:00Z"), "capture_channel": F.when(case == 6, "pigeon").otherwise("mcp"), "language_hint": F.when(case == 6, F.col("lang")).otherwise("unknown"), "raw_media": F.when(media, F.concat(F.lit("media/"), i, F.lit(".ogg"))).otherwise("null"),
        "raw_media_available": text("true"), "sha256": F.when(case == 1, F.sha2("source", 256)).when(media, F.sha2("text", 256)).otherwise(F.sha2(body, 256)), "bytes": F.octet_length("text").cast("string"), "duplicate_of": text("null"), "transcription_state": text("none"),
        "transcription_method": text("null"), "transcription_version": text("null"), "transcription_reviewed": text("false"), "quality_flags": text("[]"), "promoted_to": text("null"), "schema_version": text("1.0.0"),
    }
    head = F.concat(*[F.when((case == 2) & F.lit(n == "captured_at"), "").otherwise(value(n, v)) for n, v in fields.items()])
    events = F.concat(F.lit("- t | state:processing | x\n"), F.when(case == 3, "- t | state:promoted | x\n").otherwise(""))
    parts = {S.SECTIONS[0]: body, S.SECTIONS[1]: text("\n"), S.SECTIONS[2]: text("\n"), S.SECTIONS[3]: text("\n"), S.SECTIONS[4]: events}
    written = F.concat(*[F.when((case == 2) & F.lit(n == S.SECTIONS[2]), "").otherwise(F.concat(F.lit(f"\n## {n}\n\n"), c)) for n, c in parts.items()])
    return F.when(case == 8, F.concat(F.lit("id: x\n"), "text")).otherwise(F.concat(F.lit("---\n"), head, F.lit("---\n"), written))


@query(f"""WITH d AS (SELECT *, doc_id % 9 AS c, doc_id % 65536 AS k FROM documents WHERE {_ROWS})
SELECT doc_id, unnest(CASE c WHEN 1 THEN CASE WHEN source || '' = text || chr(10) THEN [] ELSE ['E_HASH_MISMATCH: text'] END WHEN 2 THEN ['E_MISSING_FIELD: captured_at', 'E_MISSING_SECTION: Machine description'] WHEN 3 THEN ['E_BAD_TRANSITION: processing -> promoted']
  WHEN 4 THEN ['E_MEDIA_MISSING: media/' || doc_id || '.ogg'] WHEN 5 THEN ['E_STATE_DIVERGED: processing'] WHEN 6 THEN ['E_BAD_KIND: dream', 'E_BAD_CHANNEL: pigeon'] || CASE WHEN lang IN ('fa', 'en', 'mixed', 'unknown') THEN [] ELSE ['E_BAD_LANG: ' || lang] END
  WHEN 8 THEN ['E_BAD_RECORD: no_front_matter'] ELSE [] END) AS problem FROM d""")
def capture_problems(t: Tables) -> DataFrame:
    rows = t.documents.where(_ROWS).select("doc_id", F.concat(F.lit("in/"), _id(), F.lit(".md#"), F.col("doc_id")).alias("key"), _record().alias("text"), "source", F.col("text").alias("own"))
    media = rows.where("doc_id % 9 = 7").select(F.concat(F.lit("media/"), "doc_id", F.lit(".ogg")).alias("path"), F.sha2("own", 256).alias("sha256"), F.octet_length("own").alias("bytes"))
    found = C.problems(rows.select(F.concat(F.col("doc_id"), F.lit("/"), F.regexp_extract("key", "in/(.*)#", 1)).alias("path"), "text"), media)
    return found.select(F.substring_index("path", "/", 1).cast("long").alias("doc_id"), F.concat("code", F.lit(": "), "detail").alias("problem"))


KINDS = {"claim": ("statement", "source_passage"), "intake-registration": ("original_path", "sha256"), "tier-change": ("to_tier", "reason")}


@query("""WITH s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT item_id, item_id % 8 AS c, text AS quote FROM benchmark WHERE length(text) BETWEEN 20 AND 100000),
j AS (SELECT p.*, s.doc_id AS held, coalesce(contains(s.text, left(quote, 40)), false) AS said FROM p LEFT JOIN s ON s.doc_id = item_id * 5)
SELECT item_id AS id, unnest(CASE c WHEN 0 THEN CASE WHEN held IS NULL THEN ['path_unknown'] WHEN NOT said THEN ['quote_not_found'] ELSE [] END WHEN 1 THEN ['missing: statement'] || CASE WHEN held IS NULL THEN ['quote_short', 'path_unknown'] ELSE ['quote_short'] END
  WHEN 2 THEN ['passage_missing'] WHEN 3 THEN CASE WHEN held IS NULL THEN ['original_unknown'] ELSE [] END WHEN 4 THEN ['missing: sha256', 'original_unknown', 'bad_hash'] WHEN 5 THEN ['missing: reason', 'bad_tier'] WHEN 6 THEN ['unknown_kind'] ELSE ['no_object'] END) AS problem FROM j""")
def proposal_problems(t: Tables) -> DataFrame:
    i, path = F.col("item_id"), F.concat(F.lit("d/"), F.col("item_id") * 5)
    quote = F.struct(path.alias("path"), F.substring("text", 1, 40).alias("quote"))
    case = i % 8
    kind = F.when(case < 3, "claim").when(case < 5, "intake-registration").when(case == 5, "tier-change").when(case == 6, "dream").otherwise("claim")
    body = (
        F.when(case == 0, F.to_json(F.struct(F.lit("s").alias("statement"), quote.alias("source_passage")))).when(case == 1, F.to_json(F.struct(path.alias("source_passage")))).when(case == 2, F.lit('{"statement": "s"}'))
        .when(case == 3, F.to_json(F.struct(path.alias("original_path"), F.sha2("text", 256).alias("sha256")))).when(case == 4, F.lit('{"original_path": "none"}')).when(case == 5, F.lit('{"to_tier": "gold"}')).when(case == 6, F.lit("{}")).otherwise(F.lit("[1]"))
    )
    rows = t.benchmark.where("length(text) between 20 and 100000").select(i.alias("id"), kind.alias("kind"), body.alias("body"))
    passages = t.documents.where("text is not null").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), "text")
    return C.proposal_problems(rows, passages, KINDS, ("canonical", "candidate"))
