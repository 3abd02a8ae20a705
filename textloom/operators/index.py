"""A stored keyword index: postings by term bucket, documents with fingerprints, generations that readers switch to at once.

Layout below one folder that all executors share:

* ``_log/NNN``: one small file a generation, created only if there is none, so of two writers one wins and the other starts over; it names the generation's data folder and figures,
* ``data/A/postings/bucket=B``: term, key, tf, len of the documents that the generation indexed anew, sorted by term in a file,
* ``data/A/documents``: key, fingerprint, len, since (the generation that holds its postings) of all documents,
* ``data/A/retired``: key, since of postings that no longer count.

A search reads the postings of its terms since the last compaction, less what was retired since: never the documents. Nothing that a reader of an earlier generation
sees is changed until ``vacuum`` is told that nobody is on it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import shared_path
from . import appends
from .search import B, K1, union_first

BUCKETS = 64
#: Rows of a file; a file is sorted by term, so a search reads the row groups of its terms.
FILE_ROWS = 20_000_000
FIGURES = "gen long, documents long, terms long, indexed long, lag long"


def _bucket(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def entries(spark: SparkSession, path: str) -> list[dict]:
    """What the log says of each generation."""
    return [json.loads(x) for x in appends.commits(spark, path)]


def generation(spark: SparkSession, path: str) -> int:
    """The newest generation, 0 without one."""
    return len(entries(spark, path))


def figures(spark: SparkSession, path: str) -> DataFrame:
    """gen, documents, terms, indexed, lag of every generation."""
    return spark.createDataFrame([(k, e["documents"], e["terms"], e["indexed"], e["lag"]) for k, e in enumerate(entries(spark, path), 1)], FIGURES)


def documents(spark: SparkSession, path: str, gen: int | None = None) -> DataFrame:
    log = entries(spark, path)
    return spark.read.parquet(f"{path}/data/{log[(gen or len(log)) - 1]['folder']}/documents")


def _live(log: list[dict]) -> list[tuple[int, dict]]:
    """(generation, entry) of those whose postings a search reads: from the last compaction on."""
    first = max((k for k, e in enumerate(log) if e["compact"]), default=0)
    return list(enumerate(log, 1))[first:]


def _counted(rows: DataFrame) -> DataFrame:
    """terms, an ascending list, as term, tf of its distinct ones, counted in the row (equal terms stand together); adds size, that of the list."""
    n, t, first = F.size("terms"), F.col("terms"), F.col("_first")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("_first", F.when(n > 0, places)).withColumn("size", F.when(t.isNotNull(), n.cast("long")))
    # each place with the next one, or with that behind the end
    ends = F.concat(F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), F.array(n + 1))
    return rows.withColumn("terms", F.zip_with(first, ends, lambda a, b: F.struct(F.element_at(t, a).alias("term"), (b - a).cast("long").alias("tf")))).drop("_first")


def _write_postings(each: DataFrame, where: str) -> None:
    """key, len, term, tf by bucket; a bucket is spread by the document over several times its share of the tasks, so that neither a term of every document
    nor a few buckets that meet are one task's work, and Spark cuts what is still large to its advisory size: a task sorts the same amount whatever the input."""
    parts = max(1, 4 * int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    each = each.withColumn("bucket", _bucket(F.col("term"))).withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    each = each.hint("rebalance", "bucket", "_part").sortWithinPartitions("bucket", "term", "key").drop("_part")
    each.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(where)


def refresh(rows: DataFrame, key: str, text: str, path: str, most: int | None = None, tries: int = 5) -> DataFrame:
    """Brings the index up to ``rows`` (key unique, not null) and returns the figures of the new generation.

    The rows are read once: those of a new fingerprint are tokenised and written with it, and postings, documents and figures come from
    that table. ``most`` bounds them for a run that must be short (the rows are then read twice):
    the least keys go first, and what is left counts as lag, which the next run takes up."""
    spark = rows.sparkSession
    for _ in range(tries):
        log = entries(spark, path)
        gen, folder, staged = len(log) + 1, uuid.uuid4().hex, shared_path(spark, "index-read")
        base = f"{path}/data/{folder}"
        now = rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("_t")).withColumn("fingerprint", F.sha2("_t", 256))
        stale = ~F.col("fingerprint").eqNullSafe(F.col("_f"))
        fresh = stale
        if log:
            old = documents(spark, path, gen - 1).select("key", F.col("fingerprint").alias("_f"), F.col("len").alias("_l"), F.col("since").alias("_g"))
            marked = now.join(old, "key", "left")
        else:  # nothing to join: the texts stay where they are read
            marked = now.withColumns({c: F.lit(None).cast(k) for c, k in (("_f", "string"), ("_l", "long"), ("_g", "long"))})
        if most is not None:
            picked = marked.where(stale).select("key").orderBy("key").limit(most).withColumn("_picked", F.lit(True))
            marked, fresh = marked.join(F.broadcast(picked), "key", "left"), stale & F.coalesce("_picked", F.lit(False))  # most rows
        terms = F.when(fresh, F.sort_array(T.terms(T.term_key(F.col("_t")))))
        marked = marked.select("key", "fingerprint", "_f", "_l", "_g", terms.alias("terms"), (stale & ~fresh).alias("behind"))
        _counted(marked).write.parquet(staged)
        read = spark.read.parquet(staged)
        new = read.where("size is not null").select("key", "fingerprint", F.col("size").alias("len"), F.lit(gen).cast("long").alias("since"))
        kept = read.where("size is null and _f is not null").select("key", F.col("_f").alias("fingerprint"), F.col("_l").alias("len"), F.col("_g").alias("since"))
        new.unionByName(kept).write.parquet(f"{base}/documents")
        each = read.where("size > 0").select("key", F.col("size").alias("len"), F.inline("terms"))
        held = spark.read.parquet(f"{base}/documents")
        n, total, indexed = held.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.count_if(F.col("since") == gen)).first()
        lag = read.where("behind").count()
        if indexed:
            _write_postings(each, f"{base}/postings")
        if log:
            old.select("key", F.col("_g").alias("since")).join(held.select("key", "since"), ["key", "since"], "left_anti").write.parquet(f"{base}/retired")
        entry = {"folder": folder, "compact": False, "documents": n, "terms": total, "indexed": indexed, "lag": lag, "postings": bool(indexed), "retired": bool(log)}
        if appends.create_next(spark, path, gen, json.dumps(entry)):
            return spark.createDataFrame([(gen, n, total, indexed, lag)], FIGURES)
    raise appends.Busy(path)


def compact(spark: SparkSession, path: str, tries: int = 5) -> DataFrame:
    """A generation whose postings are all in one set of files, without retired ones; figures as before, nothing indexed."""
    for _ in range(tries):
        log = entries(spark, path)
        gen, folder = len(log) + 1, uuid.uuid4().hex
        base, last = f"{path}/data/{folder}", log[-1]
        kept = _postings(spark, path, log)
        _write_postings(kept.select("key", "len", "term", "tf"), f"{base}/postings")
        documents(spark, path, gen - 1).withColumn("since", F.lit(gen).cast("long")).write.parquet(f"{base}/documents")
        entry = last | {"folder": folder, "compact": True, "indexed": 0, "postings": True, "retired": False}
        if appends.create_next(spark, path, gen, json.dumps(entry)):
            return spark.createDataFrame([(gen, last["documents"], last["terms"], 0, last["lag"])], FIGURES)
    raise appends.Busy(path)


def vacuum(spark: SparkSession, path: str, pinned: tuple[int, ...] = (), older: float = 24 * 3600) -> list[str]:
    """Deletes the data folders that neither the newest generation nor a pinned one reads, and those of writers that never finished, if
    they are ``older`` seconds or more; gives their names. Earlier generations can no longer be read."""
    log = entries(spark, path)
    needed = {e["folder"] for g in {len(log), *pinned} for _, e in _live(log[:g])}
    fs, data = appends._fs(spark, f"{path}/data")
    gone, now = [], spark.sparkContext._jvm.System.currentTimeMillis()
    for status in fs.listStatus(data) if fs.exists(data) else []:
        name = status.getPath().getName()
        if name not in needed and now - status.getModificationTime() >= 1000 * older:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def _postings(spark: SparkSession, path: str, log: list[dict], terms: list[str] | None = None) -> DataFrame:
    """key, term, tf, len that count at the log's last generation."""
    live = _live(log)
    kind = spark.read.parquet(f"{path}/data/{log[-1]['folder']}/documents").schema["key"].dataType.simpleString()
    schema = f"key {kind}, len long, term string, tf long, bucket int"
    parts = [spark.read.schema(schema).parquet(f"{path}/data/{e['folder']}/postings").withColumn("since", F.lit(g).cast("long")) for g, e in live if e["postings"]]
    p = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, since long")
    if terms is not None:
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]  # one row a query term
        p = p.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    retired = [f"{path}/data/{e['folder']}/retired" for _, e in live if e["retired"]]
    if retired:
        p = p.join(spark.read.schema(f"key {kind}, since long").parquet(*retired), ["key", "since"], "left_anti")
    return p.select("key", "term", "tf", "len")


def postings(spark: SparkSession, path: str, terms: list[str], gen: int | None = None) -> DataFrame:
    """key, term, tf, len of the terms at a generation; only the terms' buckets are read, and their files by term."""
    log = entries(spark, path)
    return _postings(spark, path, log[: gen or len(log)], terms)


def matches(spark: SparkSession, path: str, query: list[str], gen: int | None = None) -> DataFrame:
    """key, score (smaller is better, rounded to 9), found (how many of the query's terms) of every document with any, by the scores of ``search.bm25``.

    The terms' postings are read once and written by document; document counts and scores come from that table."""
    query = list(dict.fromkeys(query))
    log = entries(spark, path)
    log = log[: gen or len(log)]
    n, total = log[-1]["documents"], log[-1]["terms"]
    kept = shared_path(spark, "matches")
    _postings(spark, path, log, query).groupBy("key", "len").agg(*[F.coalesce(F.sum(F.when(F.col("term") == q, F.col("tf"))), F.lit(0)).alias(f"_f{i}") for i, q in enumerate(query)]).write.parquet(kept)
    each = spark.read.parquet(kept)
    held = each.agg(*[F.count_if(F.col(f"_f{i}") > 0) for i in range(len(query))]).first()
    score, hits = F.lit(0.0), F.lit(0)
    for i, d in enumerate(held):
        f, d = F.col(f"_f{i}"), F.lit(d)
        idf = F.log((n - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(total / max(n, 1))))
        hits = hits + (f > 0).cast("int")
    return each.select("key", F.round(score, 9).alias("score"), hits.alias("found"))


def search(spark: SparkSession, path: str, query: list[str], every: bool = True, gen: int | None = None) -> DataFrame:
    """key, score: documents with every (or any) term of the query."""
    wanted = len(set(query)) if every else 1
    return matches(spark, path, query, gen).where(F.col("found") >= wanted).select("key", "score")


def text_route(spark: SparkSession, path: str, query: str, pool: int = 120, gen: int | None = None) -> DataFrame:
    """key, list, rank, position: ``retrieve.text_route`` from stored postings, which it reads once for both lists."""
    from pyspark.sql import Window

    from .search import _tokens, top

    wanted = [t for t in _tokens(query) if t not in T.STOP_WORDS] or _tokens(query)
    hits = matches(spark, path, wanted, gen)
    ranked = lambda rows: top(rows.select("key", "score"), pool, F.col("score"), F.col("key"))
    strict = ranked(hits.where(F.col("found") == len(wanted))).select("key", "rank")
    relaxed = top(hits, pool, F.col("score"), F.col("key")).where(F.col("found") >= max(1, -(-len(wanted) // 2))).select("key", "rank")
    cut = union_first(strict, relaxed, "key").orderBy("list", "rank").limit(pool)
    return cut.withColumn("position", F.row_number().over(Window.orderBy("list", "rank")).cast("long"))
