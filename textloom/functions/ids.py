"""Content addresses: hashes of canonical strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def json_string(c: Column) -> Column:
    """A JSON string literal with non-ASCII text kept."""
    x = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    rare = x
    for k in set(range(32)) - {8, 9, 10, 12, 13}:
        rare = F.replace(rare, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.concat(F.lit('"'), F.when(x.rlike("[\\x00-\\x1f]"), rare).otherwise(x), F.lit('"'))


def canonical_json(**parts: Column) -> Column:
    """Keys in order, no spaces; values are JSON already."""
    body = []
    for i, key in enumerate(sorted(parts)):
        body += [F.lit(("," if i else "") + f'"{key}":'), parts[key]]
    return F.concat(F.lit("{"), *body, F.lit("}"))


def artifact_id(instance: str, ref: Column) -> Column:
    return sha(F.concat(F.lit(instance), F.char(F.lit(0)), ref))


def entity_id(ref: Column, name: Column) -> Column:
    return F.concat(F.lit("ent:"), F.substring(sha(F.concat_ws(chr(0), F.lit("ent"), ref, name)), 1, 24))


def source_version(ref: Column, layer: str, text: Column, origin: str = "record") -> Column:
    """Version of a source of one text layer: the hash of what the layer is and holds."""
    name = F.lit(f'"{layer}"')
    own = canonical_json(layer_id=name, origin=F.lit(f'"{origin}"'), provenance_sha256=F.lit("null"), text_ref=json_string(F.concat(ref, F.lit(f"#{layer}"))), text_sha256=json_string(sha(text)))
    return sha(canonical_json(v=F.lit("1"), source_ref=json_string(ref), layers=F.concat(F.lit("["), own, F.lit("]"))))


def chunk_digest(source_ref: Column, version: Column, layer: Column, start: Column, end: Column, chunker: Column) -> Column:
    """Hash of a chunk's address as a JSON array."""
    parts = [json_string(source_ref), json_string(version), json_string(layer), start.cast("string"), end.cast("string"), json_string(chunker)]
    return sha(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))


def snapshot_hash(key: Column, digest: Column) -> Column:
    """Aggregate: one hash over key:digest lines in key order."""
    return sha(F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), digest))), "\n"))
