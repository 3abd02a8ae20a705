"""Holdings: contradictions, verdicts, archives, release scope; answers: phantom paths, faithfulness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths and kinds outside the release; shape of a path in an answer.
OUTSIDE_PATHS = ("02-sources/", ".claude/", "00-system/templates/")
OUTSIDE_KINDS = ("source-record", "machine-extracted-text", "capture")
PATH = r"([A-Za-z0-9_\-./‌]+\.md\b)"


def contradictions(records: DataFrame, path: str, status: str, manifest: DataFrame, registered: str = "registered") -> DataFrame:
    """path of records whose status claims what the manifest does not say, or the other way round."""
    listed = manifest.select(F.col(path), F.lit(True).alias("_in")).distinct()
    claims = F.coalesce(F.col(status) == registered, F.lit(False))
    return records.join(listed, path, "left").where(claims != F.coalesce("_in", F.lit(False))).select(path)


def summary(rows: DataFrame, path: str, first: int = 5) -> DataFrame:
    """count, first: how many rows and the least of them; the report shows no more."""
    few = rows.orderBy(path).limit(first).agg(F.array_join(F.array_sort(F.collect_list(path)), ",").alias("first"))
    return rows.agg(F.count("*").alias("count")).crossJoin(F.broadcast(few))  # one row each


def verdict(**findings: DataFrame) -> DataFrame:
    """findings, verdict: all rows of the given frames counted."""
    parts = [f.agg(F.count("*").alias("n")) for f in findings.values()]
    total = reduce(DataFrame.unionByName, parts).agg(F.sum("n").alias("findings"))
    text = F.when(F.col("findings") == 0, "CENSUS CLEAN").otherwise(F.concat(F.lit("CENSUS DRIFT: "), F.col("findings").cast("string"), F.lit(" findings")))
    return total.select("findings", text.alias("verdict"))


def archive_problems(manifest: DataFrame, files: DataFrame, path: str, digest: str, forbidden: str) -> DataFrame:
    """path, problem: missing members, changed ones, unlisted files, and members that match the forbidden pattern."""
    a, b = manifest.select(path, F.col(digest).alias("_a"), F.lit(True).alias("_in_a")), files.select(path, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, path, "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("_in_b").isNull(), F.lit("missing")), F.when(F.col("_in_a").isNull(), F.lit("unlisted")),
        F.when(F.col("_in_a") & F.col("_in_b") & ~F.col("_a").eqNullSafe(F.col("_b")), F.lit("changed")), F.when(F.col(path).rlike(forbidden), F.lit("forbidden")),
    ))
    return j.select(path, F.explode(found).alias("problem"))


def ignored(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the folders or below it."""
    return reduce(lambda a, b: a | b, [path.startswith(p) | (path == p.rstrip("/")) for p in prefixes])


def curated(path: Column, kind: Column, ident: Column) -> Column:
    """Whether a record belongs to the release: inside it, of a kind that is, with an id."""
    outside = reduce(lambda a, b: a | b, [path.startswith(p) for p in OUTSIDE_PATHS])
    named = (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(ident, F.lit("")) != "")
    return ~outside & named & ~F.coalesce(kind.isin(*OUTSIDE_KINDS), F.lit(False))


def head_status(text: Column, head: int = 4000) -> Column:
    """status of a leading block, looked for in the first ``head`` characters: unknown without one, null without a block."""
    start = F.substring(text, 1, head)
    block = F.split(start, r"\n---", 2)[0]
    value = F.regexp_replace(F.regexp_extract(block, r"(?m)^status:[ \t]*(.*?)[ \t]*$", 1), r"^['\"]+|['\"]+$", "")
    return F.when(start.startswith("---"), F.when(value == "", "unknown").otherwise(value))


def phantom_paths(answers: DataFrame, key: str, answer: str, files: DataFrame, retrieved: DataFrame) -> DataFrame:
    """key, path, status of the paths that an answer names: ok if there is such a file, unresolved if only retrieval gave it, else phantom.

    ``files`` has path; ``retrieved`` has key and path, which meet in lower case."""
    bare = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^[./]+", "")
    named = answers.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(answer), F.lit(PATH), 1), bare))).alias("path"))
    there = files.select("path", F.lit(True).alias("_file")).distinct()
    seen = retrieved.select(key, F.lower("path").alias("_p"), F.lit(True).alias("_seen")).distinct()
    j = named.join(there, "path", "left").withColumn("_p", F.lower("path")).join(seen, [key, "_p"], "left")
    return j.select(key, "path", F.when(F.col("_file"), "ok").when(F.col("_seen"), "unresolved").otherwise("phantom").alias("status"))


def faithfulness(claims: DataFrame, citations: DataFrame, paths: DataFrame, key: str, least: float, least_precision: float) -> DataFrame:
    """mean, precision, phantoms, passed: a case scores its supported claims and half its partial ones; null without claims or citations."""
    score = claims.groupBy(key).agg(F.round(F.avg(F.when(F.col("support") == "supported", 1.0).when(F.col("support") == "partial", 0.5).otherwise(0.0)), 3).alias("_s"))
    mean = score.agg(F.round(F.avg("_s"), 3).alias("mean"))
    precision = citations.agg(F.round(F.avg((F.col("status") == "ok").cast("double")), 3).alias("precision"))
    phantom = paths.agg(F.count_if(F.col("status") == "phantom").alias("phantoms"))
    one = mean.crossJoin(F.broadcast(precision)).crossJoin(F.broadcast(phantom))  # one row each
    passed = F.coalesce((F.col("mean") >= least) & (F.col("precision") >= least_precision) & (F.col("phantoms") == 0), F.lit(False))
    return one.withColumn("passed", passed)
