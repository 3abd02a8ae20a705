"""Appends with a check of what they build on: a log of numbered commits, each made by creating a file that must not exist.

``_log/NNN`` names the data folders of commit NNN. A writer reads a snapshot, judges its rows against it, writes them, and creates the next
log file; where another writer was faster the create fails, and it judges anew against the newer snapshot (its data folder stays unnamed, so unseen). Creating is as
atomic as the store's ``create`` without overwrite (HDFS and stores with conditional puts are). The driver holds commit names alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import shared_path

ANNOTATIONS = "source string, revision long, version string, key string, digest string, body string"
REVIEWS = "source string, revision long, decision string, actor string, note string"


class Busy(RuntimeError):
    """Other writers won every try."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, path: str) -> list[str]:
    """Data folders in order of commit."""
    fs, log = _fs(spark, f"{path}/_log")
    if not fs.exists(log):
        return []
    out = []
    for file in sorted((s.getPath() for s in fs.listStatus(log) if not s.getPath().getName().startswith((".", "_"))), key=lambda p: p.getName()):
        stream = fs.open(file)
        try:
            out.append(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
    return out


def snapshot(spark: SparkSession, path: str, schema: str) -> tuple[int, DataFrame]:
    """(number of commits, all rows of them)."""
    folders = commits(spark, path)
    return len(folders), spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def create_next(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Makes commit ``number``; False if there is one."""
    fs, file = _fs(spark, f"{path}/_log/{number:020d}")
    try:
        stream = fs.create(file, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(file):
            return False
        raise
    try:
        stream.write(bytearray(folder.encode()))
    finally:
        stream.close()
    return True


def commit(spark: SparkSession, path: str, schema: str, judge: Callable[[DataFrame], DataFrame], tries: int = 5) -> DataFrame:
    """The judged rows (with ``outcome``) of the try that went through; rows ``stored`` are appended.

    judge: snapshot -> the schema's columns and outcome. Raises Busy after ``tries`` lost races."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    for _ in range(tries):
        number, rows = snapshot(spark, path, schema)
        kept = shared_path(spark, "judged")
        judge(rows).write.parquet(kept)
        judged = spark.read.parquet(kept)
        new = judged.where("outcome = 'stored'").select(*names)
        if new.isEmpty():
            return judged
        folder = uuid.uuid4().hex
        new.write.parquet(f"{path}/data/{folder}")
        if create_next(spark, path, number + 1, folder):
            return judged
    raise Busy(path)


def append_annotations(requests: DataFrame, sources: DataFrame, path: str, tries: int = 5) -> DataFrame:
    """requests (source, version, expected, key, body) with outcome and revision; sources: source, version (null: none current).

    In this order: bad_request (null source, key or body), replay or key_conflict (the key was used, with the same request or another one), not_found, stale (not the source's current version),
    conflict (``expected`` is not the newest revision), stored. Of requests in one call that a source could take, the least key is stored and
    the rest conflict; a key twice in one call is judged against its first."""
    spark = requests.sparkSession
    r = requests.select("source", "version", "expected", "key", "body").withColumn("digest", F.sha2(F.to_json(F.struct("source", "version", "expected", "body")), 256))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("source", "key").orderBy("digest")))
    here = F.first("digest").over(Window.partitionBy("source", "key").orderBy("digest"))
    r = r.withColumn("_first", here)

    def judge(rows: DataFrame) -> DataFrame:
        now = rows.groupBy(F.col("source").alias("_s")).agg(F.max("revision").alias("_newest"))
        used = rows.groupBy(F.col("source").alias("_u"), F.col("key").alias("_k")).agg(F.min("digest").alias("_used"))
        held = sources.groupBy(F.col("source").alias("_h")).agg(F.max("version").alias("_current"))
        j = r.join(now, F.col("source") == F.col("_s"), "left").join(used, (F.col("source") == F.col("_u")) & (F.col("key") == F.col("_k")), "left").join(held, F.col("source") == F.col("_h"), "left")
        newest = F.coalesce("_newest", F.lit(0))
        before = F.coalesce("_used", F.when(F.col("_n") > 1, F.col("_first")))
        outcome = (
            F.when(F.col("source").isNull() | F.col("key").isNull() | F.col("body").isNull(), "bad_request").when(before == F.col("digest"), "replay").when(before.isNotNull(), "key_conflict")
            .when(F.col("_h").isNull(), "not_found").when(~F.coalesce(F.col("_current") == F.col("version"), F.lit(False)), "stale").when(~F.coalesce(F.col("expected") == newest, F.lit(False)), "conflict").otherwise("open")
        )
        j = j.withColumn("outcome", outcome)
        place = F.row_number().over(Window.partitionBy("source", "outcome").orderBy("key"))
        j = j.withColumn("outcome", F.when(F.col("outcome") == "open", F.when(place == 1, "stored").otherwise("conflict")).otherwise(F.col("outcome")))
        return j.select("source", F.when(F.col("outcome") == "stored", newest + 1).cast("long").alias("revision"), "version", "key", "digest", "body", "outcome", newest.cast("long").alias("newest"))

    return commit(spark, path, ANNOTATIONS, judge, tries)


def append_reviews(requests: DataFrame, annotations: DataFrame, path: str, tries: int = 5) -> DataFrame:
    """requests (source, revision, decision, actor, note) with outcome: bad_request, not_found (no such revision), stored. Reviews are only ever added."""
    bad = F.col("source").isNull() | (F.coalesce("revision", F.lit(0)) < 1) | ~F.coalesce(F.col("decision").isin("confirmed", "rejected"), F.lit(False)) | (F.length(F.trim(F.coalesce("actor", F.lit("")))) == 0) | (F.length("actor") > 80) | (F.coalesce(F.length("note"), F.lit(0)) > 500)

    def judge(_: DataFrame) -> DataFrame:
        known = annotations.select(F.col("source").alias("_s"), F.col("revision").alias("_r")).distinct()
        j = requests.join(known, (F.col("source") == F.col("_s")) & (F.col("revision") == F.col("_r")), "left")
        outcome = F.when(bad, "bad_request").when(F.col("_s").isNull(), "not_found").otherwise("stored")
        return j.select("source", F.col("revision").cast("long").alias("revision"), "decision", F.trim("actor").alias("actor"), "note", outcome.alias("outcome"))

    return commit(requests.sparkSession, path, REVIEWS, judge, tries)

