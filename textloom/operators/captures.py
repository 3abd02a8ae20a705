"""Capture records judged: fields, sections, media, states. Rules are columns over the parsed record; media meet by one join on their path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sections as S

# What a record may say, which state may follow which, what kind of capture a file's suffix stands for.
KINDS = ("text", "voice", "handwriting", "drawing", "image", "file", "mixed")
CHANNELS = ("telegram-hermes", "claude-mobile", "obsidian", "mcp", "filesystem")
LANGUAGES = ("fa", "en", "mixed", "unknown")
NEEDS = ("needs_transcription", "needs_description", "needs_interpretation")
SCHEMA, TIER, REQUIRED = "1.0.0", "candidate", S.FIELDS[:20]
NEXT = {
    "received": ("processing", "reviewed"), "processing": ("transcribed", "described", "needs-review", "processing-failed"), "transcribed": ("reviewed",), "described": ("reviewed",), "needs-review": ("reviewed",),
    "processing-failed": ("processing", "reviewed"), "reviewed": ("parked", "promoted"), "parked": (), "promoted": (),
}
SUFFIXES = {"voice": "ogg opus oga m4a mp3 wav flac amr", "image": "jpg jpeg png gif webp heic tif tiff", "file": "pdf txt md csv"}
ID, HEX, METHOD = r"^cap-\d{8}-\d{6}-[0-9a-f]{4}\z", r"^[0-9a-f]{64}\z", r"^(literal|description|interpretation):[A-Za-z0-9._-]+\z"


def _field(name: str) -> Column:
    return F.get(F.filter("p.fields", lambda f: f["name"] == name), F.lit(0))


def _value(name: str) -> Column:
    return _field(name)["value"]


def _section(name: str) -> Column:
    return F.get(F.filter("p.sections", lambda s: s["name"] == name), F.lit(0))["content"]


def _one(code: str, wrong: Column, detail: Column | str = "") -> Column:
    """A problem if ``wrong`` (null counts as wrong)."""
    said = F.lit(detail) if isinstance(detail, str) else F.coalesce(detail.cast("string"), F.lit(""))
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.struct(F.lit(code).alias("code"), said.alias("detail")))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<code:string,detail:string>>")


def _each(code: str, details: Column) -> Column:
    return F.transform(details, lambda d: F.struct(F.lit(code).alias("code"), d.alias("detail")))


def states(events: Column) -> Column:
    """The path of states that a record's events tell, one a line at most, from ``received`` on."""
    told = F.transform(F.split(F.coalesce(events, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.regexp_extract(x, r"\|\s*state:([a-z-]+)\s*\|", 1))
    return F.concat(F.array(F.lit("received")), F.filter(told, lambda s: s != ""))


def problems(records: DataFrame, media: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, code, detail of every rule that a record breaks; records that break none have no row.

    media: path, sha256, bytes of the files that are there (path once each). A record that can't be parsed has E_BAD_RECORD alone. Null texts have it too."""
    df = records.select(F.col(path).alias("_path"), S.parse(F.col(text)).alias("p"))
    df = df.withColumns({"_raw": F.when(_value("raw_media") != "", _value("raw_media")), "_kind": _value("capture_kind"), "_sha": _value("sha256"), "_status": _value("status")})
    held = media.select(F.col("path").alias("_m"), F.col("sha256").alias("_msha"), F.col("bytes").alias("_mbytes"))
    df = df.join(held, F.col("_raw") == F.col("_m"), "left").withColumn("_states", states(_section("Provenance events")))
    away = F.col("_raw").contains("..") | F.col("_raw").startswith("/")
    suffix = F.lower(F.regexp_extract("_raw", r"\.([^./]+)$", 1))
    stands = F.lit(None).cast("string")
    for kind, names in SUFFIXES.items():
        stands = F.when(suffix.isin(*names.split()), kind).otherwise(stands)
    fits = F.coalesce(F.col("_kind") == stands, F.lit(False)) | F.coalesce(F.col("_kind") == "mixed", F.lit(False)) | (F.coalesce(F.col("_kind").isin("handwriting", "drawing"), F.lit(False)) & F.coalesce(stands == "image", F.lit(False)))
    of_media = (
        F.when(away, _one("E_TRAVERSAL", F.lit(True), "raw_media")).when(F.col("_m").isNull(), _one("E_MEDIA_MISSING", F.lit(True), F.col("_raw"))).when(~F.coalesce(F.col("_msha") == F.col("_sha"), F.lit(False)), _one("E_HASH_MISMATCH", F.lit(True), "media"))
        .when(~F.coalesce(F.col("_mbytes").cast("string") == _value("bytes"), F.lit(False)), _one("E_SIZE_MISMATCH", F.lit(True))).otherwise(_one("E_MEDIA_MISMATCH", ~fits, F.col("_kind")))
    )
    own_text = (F.col("_kind") == "text") & ~F.coalesce(F.sha2(F.coalesce(_section(S.SECTIONS[0]), F.lit("")), 256) == F.col("_sha"), F.lit(False))
    of_text = F.when(F.coalesce(own_text, F.lit(False)), _one("E_HASH_MISMATCH", F.lit(True), "text")).otherwise(_none())
    given = lambda n: _field(n).isNotNull() & (_field(n)["kind"] != "null")
    items = lambda n: F.coalesce(_field(n)["items"], F.array().cast("array<struct<kind:string,value:string>>"))
    is_list = lambda n: F.coalesce(_field(n)["kind"] == "list", F.lit(False))
    said = lambda n: F.coalesce(_value(n), F.lit(""))
    methods = items("derivative_methods")
    claimed = is_list("derivative_methods") & F.exists(methods, lambda m: F.coalesce(m["value"].endswith(":claude"), F.lit(False)))
    steps = F.arrays_zip(F.slice("_states", F.lit(1), F.size("_states") - 1).alias("a"), F.slice("_states", F.lit(2), F.size("_states")).alias("b"))
    moves = [(a, b) for a, to in NEXT.items() for b in to]
    bad_step = F.get(F.filter(F.transform(steps, lambda x: F.concat(x["a"], F.lit(" -> "), x["b"])), lambda s: ~s.isin(*[f"{a} -> {b}" for a, b in moves])), F.lit(0))
    rules = [
        _each("E_AMBIGUOUS_BODY", F.col("p.ambiguous")), _one("E_BAD_ID", ~_value("id").rlike(ID)), _one("E_FILENAME_MISMATCH", F.regexp_extract("_path", r"([^/]*)\z", 1) != F.concat(F.coalesce(_value("id"), F.lit("None")), F.lit(".md"))),
        _each("E_MISSING_FIELD", F.filter(F.array(*map(F.lit, REQUIRED)), lambda n: ~F.exists("p.fields", lambda f: f["name"] == n))), _one("E_BAD_TYPE", _value("type") != "capture"), _one("E_BAD_STATE", ~F.col("_status").isin(*NEXT), F.col("_status")),
        _one("E_BAD_KIND", ~F.col("_kind").isin(*KINDS), F.col("_kind")), _one("E_BAD_CHANNEL", ~_value("capture_channel").isin(*CHANNELS), said("capture_channel")), _one("E_BAD_LANG", ~_value("language_hint").isin(*LANGUAGES), said("language_hint")),
        _one("E_BAD_SCHEMA", _value("schema_version") != SCHEMA), _one("E_BAD_HASH", ~F.col("_sha").rlike(HEX)), _each("E_MISSING_SECTION", F.filter(F.array(*map(F.lit, S.SECTIONS)), lambda n: ~F.exists("p.sections", lambda s: s["name"] == n))),
        F.when(F.col("_raw").isNotNull(), of_media).otherwise(of_text),
        _one("E_BAD_NEEDS", given("interpretation_needs") & (~is_list("interpretation_needs") | F.exists(items("interpretation_needs"), lambda x: ~F.coalesce(x["value"].isin(*NEEDS), F.lit(False))))),
        _one("E_BAD_DERIVATIVE_METHOD", given("derivative_methods") & (~is_list("derivative_methods") | F.exists(methods, lambda m: ~F.coalesce((m["kind"] == "text") & m["value"].rlike(METHOD), F.lit(False))))),
        _one("E_BAD_TIER", _field("derivative_tier").isNotNull() & (said("derivative_tier") != TIER), said("derivative_tier")), _one("E_BAD_TIER", claimed & (said("derivative_tier") != TIER), "method"),
        _one("E_UNATTRIBUTED_DERIVATIVE", F.coalesce(_section(S.OPTIONAL[0]).rlike(r"\S"), F.lit(False)) & ~F.exists(methods, lambda m: F.coalesce(m["value"].startswith("interpretation:") | (m["value"] == "interpretation"), F.lit(False)))),
        F.when(bad_step.isNotNull(), _one("E_BAD_TRANSITION", F.lit(True), bad_step)).otherwise(_none()), _one("E_STATE_DIVERGED", ~F.coalesce(F.col("_status") == F.element_at("_states", -1), F.lit(False)), F.element_at("_states", -1)),
    ]
    error = F.when(F.col("p").isNull(), "null").otherwise(F.col("p.error"))
    every = F.when(error.isNotNull(), _one("E_BAD_RECORD", F.lit(True), error)).otherwise(F.concat(*rules))
    return df.select(F.col("_path").alias(path), F.explode(every).alias("x")).select(path, "x.code", "x.detail")


def proposal_problems(proposals: DataFrame, passages: DataFrame, kinds: dict[str, tuple[str, ...]], tiers: tuple[str, ...], least_quote: int = 20) -> DataFrame:
    """id, problem of proposals (id, kind, body: a JSON object as text) by the rules of their kind; passages: path, text of what may be cited.

    unknown_kind; no_object; missing: a required field; passage_missing, quote_short, path_missing, path_unknown, quote_not_found; original_unknown, bad_hash
    (kind intake-registration); bad_tier (tier-change). A passage is an object of path and quote, or a path alone, which has no quote. Its text is met by one join on the path."""
    get = lambda c, k: F.get_json_object(c, f"$.{k}")
    df = proposals.select("id", "kind", "body", F.json_object_keys("body").alias("_keys"), get("body", "source_passage").alias("_sp"))
    is_object = F.json_object_keys("_sp").isNotNull()
    df = df.withColumns({"_path": F.trim(F.when(is_object, F.coalesce(get("_sp", "path"), F.lit(""))).otherwise(F.coalesce("_sp", F.lit("")))), "_quote": F.when(is_object, F.coalesce(get("_sp", "quote"), F.lit(""))).otherwise(F.lit(""))})
    df = df.join(passages.select(F.col("path").alias("_p"), F.col("text").alias("_t")), F.col("_path") == F.col("_p"), "left")
    df = df.join(passages.select(F.col("path").alias("_o")).distinct(), get("body", "original_path") == F.col("_o"), "left")
    required = F.lit(None).cast("array<string>")
    for kind, fields in kinds.items():
        required = F.when(F.col("kind") == kind, F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")).otherwise(required)
    df = df.withColumn("_required", required)
    when = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    cites = F.array_contains("_required", "source_passage")
    there = cites & F.col("_sp").isNotNull()
    missing = F.transform(F.filter("_required", lambda f: (f != "source_passage") & ~F.array_contains("_keys", f)), lambda f: F.concat(F.lit("missing: "), f))
    rules = F.array_compact(F.array(
        when(cites & F.col("_sp").isNull(), "passage_missing"), when(there & (F.length("_quote") < least_quote), "quote_short"), when(there & (F.col("_path") == ""), "path_missing"), when(there & (F.col("_path") != "") & F.col("_p").isNull(), "path_unknown"),
        when(there & F.col("_p").isNotNull() & (F.col("_quote") != "") & ~F.contains("_t", F.col("_quote")), "quote_not_found"), when((F.col("kind") == "intake-registration") & F.col("_o").isNull(), "original_unknown"),
        when((F.col("kind") == "intake-registration") & ~F.coalesce(get("body", "sha256").rlike(r"\b[0-9a-f]{64}\b"), F.lit(False)), "bad_hash"), when((F.col("kind") == "tier-change") & ~F.coalesce(get("body", "to_tier").isin(*tiers), F.lit(False)), "bad_tier"),
    ))
    every = F.when(F.col("_required").isNull(), F.array(F.lit("unknown_kind"))).when(F.col("_keys").isNull(), F.array(F.lit("no_object"))).otherwise(F.concat(missing, rules))
    return df.select("id", F.explode(every).alias("problem"))
