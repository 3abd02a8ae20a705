"""Evidence: verbatim quotes, claim support, citations, retrieval figures."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import lines
from ..functions import text as T

LEAST_QUOTE = 20
#: Twice this less one is at most LEAST_QUOTE, so any place of a quote covers a whole block.
BLOCK = 10
#: Characters of quotes that are sent to every task at most.
HELD = 1_000_000


def verbatim(quotes: DataFrame, quote_key: str, quote: str, rows: DataFrame, key: str, text: str, held: int = HELD) -> DataFrame:
    """quote_key, key, at (1-based, of its first place): documents that hold a quote of LEAST_QUOTE characters or more as written.

    Quotes of up to ``held`` characters in all are sent to the texts as one automaton, and each text is read once. Beyond that a quote is found by its longest inner word, which is a whole word of
    the text too: texts and quotes meet on a term, then the text is searched. One without an inner word meets texts on a block: of LEAST_QUOTE characters, BLOCK stand in one of the blocks that a
    text is cut into."""
    asked = quotes.where((F.length(quote) >= LEAST_QUOTE) & F.col(quote_key).isNotNull()).select(quote_key, F.col(quote).alias("_q")).distinct()
    if (asked.agg(F.sum(F.length("_q"))).first()[0] or 0) <= held:
        return _scanned(asked, quote_key, rows, key, text)
    return _joined(asked, quote_key, rows, key, text)


def _scanned(asked: DataFrame, quote_key: str, rows: DataFrame, key: str, text: str) -> DataFrame:
    """All quotes (of a bounded size) in one pass over each text."""
    keys: dict[str, list] = {}
    for k, q in asked.collect():
        keys.setdefault(q, []).append(k)
    sent = rows.sparkSession.sparkContext.broadcast(keys)
    df = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = StructType([StructField("quote", asked.schema[quote_key].dataType), df.schema["key"], StructField("at", LongType())])
    kind = to_arrow_schema(out).field("quote").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for q, ks in sent.value.items():
            automaton.add_word(q, (q, ks))
        automaton.make_automaton()
        for batch in batches:
            found, places, owner = [], [], []
            for d, t in enumerate(batch.column("text").to_pylist() if sent.value else []):
                first: dict[str, tuple[int, list]] = {}
                for end, (q, ks) in automaton.iter(t or ""):
                    first.setdefault(q, (end - len(q) + 2, ks))
                for at, ks in first.values():
                    found += ks
                    places += [at] * len(ks)
                    owner += [d] * len(ks)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column("key").take(pa.array(owner, pa.int64())), pa.array(places, pa.int64())], names=["quote", "key", "at"])

    return df.mapInArrow(run, out).select(F.col("quote").alias(quote_key), F.col("key").alias(key), "at")


def _joined(q: DataFrame, quote_key: str, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Quotes of any number, met on words or blocks."""
    # the inner words of a quote are whole terms of a text; the first and last may be cut
    inner = F.expr("slice(_ws, 2, greatest(size(_ws) - 2, 0))")
    q = q.withColumn("_ws", F.regexp_extract_all("_q", F.lit(r"([\p{L}\p{N}]+)"), 1)).withColumn("_in", inner)
    q = q.withColumn("_w", F.array_max(F.transform("_in", lambda t: F.struct(F.length(t), t.alias("t"))))["t"])
    words = rows.select(key, F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("_ts"))
    needles = q.where("_w is not null").select(quote_key, "_q", "_w")
    met = words.select(key, F.explode("_ts").alias("_w")).join(needles, "_w").select(key, quote_key, "_q")
    bare = q.where("_w is null").select(quote_key, "_q")
    if not bare.isEmpty():
        blocks = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{{BLOCK}}})"), 1))).alias("_w"))
        grams = bare.select("_q").distinct().select("_q", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(_q) - {BLOCK - 1}), i -> substring(_q, i, {BLOCK}))"))).alias("_w"))
        met = met.unionByName(blocks.join(grams, "_w").select(key, "_q").distinct().join(bare, "_q").select(key, quote_key, "_q"))
    found = met.join(rows.select(key, F.col(text).alias("_x")), key).withColumn("at", F.expr("instr(_x, _q)").cast("long"))
    return found.where("at > 0").select(quote_key, key, "at")


def claim_support(claims: DataFrame, claim_key: str, claim: str, passage: str) -> DataFrame:
    """claim_key, overlap, verdict: share of the claim's content words in the passage, and whether they stand there in order."""
    want = T.content_terms(F.col(claim))
    have = T.terms(T.norm(F.col(passage)))
    df = claims.select(claim_key, want.alias("_w"), have.alias("_h"))
    df = df.withColumn("overlap", F.round(F.when(F.size("_w") == 0, 0.0).otherwise(F.size(F.array_intersect("_w", "_h")) / F.size("_w")), 6))
    # greedy subsequence of the words that are there: the position behind the last match, or 0 once lost
    df = df.withColumn("_w", F.array_intersect("_w", "_h"))
    ordered = F.expr("aggregate(_w, 1, (p, w) -> if(p = 0, 0, if(array_position(slice(_h, p, size(_h)), w) = 0, 0, cast(p + array_position(slice(_h, p, size(_h)), w) as int))))") > 0
    verdict = F.when((F.col("overlap") >= 0.75) & ordered, "supported").when(F.col("overlap") >= 0.45, "partial").otherwise("unsupported")
    return df.select(claim_key, "overlap", verdict.alias("verdict"))


def citation_status(cites: DataFrame, key: str, span: str, ref: str, passages: DataFrame, passage_ref: str, passage: str) -> DataFrame:
    """key, status: NO_SPAN, BAD_PASSAGE_REF, SPAN_NOT_FOUND or OK."""
    p = passages.select(F.col(passage_ref).alias("_r"), F.col(passage).alias("_p"))
    j = cites.join(p, F.col(ref) == F.col("_r"), "left")
    s = F.when(F.coalesce(F.length(span), F.lit(0)) == 0, "NO_SPAN").when(F.col("_r").isNull(), "BAD_PASSAGE_REF").when(~F.contains("_p", F.col(span)), "SPAN_NOT_FOUND").otherwise("OK")
    return j.select(key, s.alias("status"))


def retrieval_metrics(hits: DataFrame, expected: DataFrame, query: str, item: str, category: str) -> DataFrame:
    """category (and ``total``), queries, hit_at_1, hit_at_5, recall_at_10, mrr."""
    j = expected.join(hits, [query, item], "left")
    per = j.groupBy(query, category).agg(F.min("rank").alias("best"), F.avg(F.when(F.col("rank") <= 10, 1.0).otherwise(0.0)).alias("recall"))
    per = per.select(F.explode(F.array(F.col(category), F.lit("total"))).alias("category"), "best", "recall")
    return per.groupBy("category").agg(
        F.count("*").alias("queries"), F.count_if(F.col("best") == 1).alias("hit_at_1"), F.count_if(F.col("best") <= 5).alias("hit_at_5"),
        F.round(F.avg("recall"), 6).alias("recall_at_10"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
    )


def changed_lines(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, changed: lines taken out and put in between two texts, as few as there can be."""
    return rows.select(key, lines.changed_lines(F.col(old), F.col(new)).alias("changed"))
