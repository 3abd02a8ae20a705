"""Exact search that answers with places in the source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import positions as P
from .registry import Tables, query


def hits_sql(rows: str, key: str, needles: dict[str, str], flags: str = "(?i)") -> str:
    """DuckDB's hits of needles (name: pattern over the text as it is), for texts without joiners and marks."""
    listed = ", ".join(f"('{n}', '{flags}{p}')" for n, p in needles.items())
    return rf"""
WITH n AS (SELECT * FROM (VALUES {listed}) AS v(needle, pattern)),
m AS (SELECT {key}, text, needle, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS ps FROM {rows}, n WHERE regexp_matches(text, pattern)),
s AS (SELECT {key}, text, needle, ms, [list_sum([length(p) FOR p IN ps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) FOR i IN range(1, len(ms) + 1)]::BIGINT[] AS starts FROM m),
l AS (SELECT *, [length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) + 1 FOR p IN starts]::BIGINT[] AS each FROM s)
SELECT {key}, needle, len(ms)::BIGINT AS hit_count, array_to_string(starts, ',') AS starts, array_to_string([starts[i] + length(ms[i]) FOR i IN range(1, len(ms) + 1)]::BIGINT[], ',') AS ends, each[1] AS line, array_to_string(list_sort(list_distinct(each))[1:3], ',') AS lines,
  replace(substr(text, greatest(starts[1] - 80, 0) + 1, starts[1] - greatest(starts[1] - 80, 0) + length(needle) + 120), chr(10), ' ') AS context
FROM l"""


def _joined(hits: DataFrame) -> DataFrame:
    return hits.withColumns({c: F.array_join(c, ",") for c in ("starts", "ends", "lines")})


NEEDLES = {"of  The": r"of\s+the", "(c)": r"\(c\)", "www.": r"www\."}


@query(hits_sql("documents", "doc_id", NEEDLES))
def exact_source_places(t: Tables) -> DataFrame:
    return _joined(P.find(t.documents, "doc_id", "text", list(NEEDLES)))


@query(hits_sql("conversations", "conv_id, turn", {"The": "The"}, "").replace("conv_id, turn", "key").replace("FROM conversations", "FROM (SELECT conv_id || '-' || turn AS key, text FROM conversations)"))
def exact_case_sensitive_places(t: Tables) -> DataFrame:
    """Characters as they are: no folding."""
    rows = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return _joined(P.find(rows, "key", "text", ["The"], fold=False))


@query(r"""WITH x AS (SELECT item_id, text, replace(lower(text), 'ß', 'ss') AS low FROM benchmark)
SELECT item_id, trim(regexp_replace(low, '\s+', ' ', 'g')) AS form, (length(text) - 1)::BIGINT AS last_place FROM x""")
def source_map_ends(t: Tables) -> DataFrame:
    """Forms of the benchmark's texts, with the place of their last character."""
    m = P.source_map(t.benchmark, "item_id", "text")
    return m.select("item_id", F.trim("form").alias("form"), F.element_at("at", -1).cast("long").alias("last_place"))
