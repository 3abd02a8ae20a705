"""Versions: upserts, effective annotations, latest reviews, generations, states, queues, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """key, version, action (created, unchanged, new_version, reactivated) of incoming rows, and ``missing`` for keys not in it.

    ``current`` holds every known version with a boolean is_current."""
    known = current.select(key, version).distinct().withColumn("_seen", F.lit(True))
    now = current.where("is_current").select(key, F.col(version).alias("_now"))
    j = incoming.select(key, version).join(known, [key, version], "left").join(now, key, "full_outer")
    action = (
        F.when(F.col(version).isNull(), "missing").when(F.col("_now").isNull() & F.col("_seen").isNull(), "created").when(F.col(version) == F.col("_now"), "unchanged")
        .when(F.col("_seen"), "reactivated").otherwise("new_version")
    )
    return j.select(key, F.coalesce(version, "_now").alias(version), action.alias("action"))


def effective(revisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, revision and, per field, the newest value among revisions from the last complete, not rejected one on."""
    live = revisions.where("not rejected")
    base = live.groupBy(key).agg(F.max(F.when(F.col("complete"), F.col("revision"))).alias("_base"))
    window = live.join(base, key).where("_base is null or revision >= _base")
    return window.groupBy(key).agg(F.max("revision").alias("revision"), *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("revision"))).alias(f) for f in fields])


def latest_review(items: DataFrame, reviews: DataFrame, key: str, order: str, decision: str) -> DataFrame:
    """key, state: the last decision, or unreviewed."""
    last = reviews.groupBy(key).agg(F.max_by(decision, order).alias("_d"))
    return items.select(key).join(last, key, "left").select(key, F.coalesce("_d", F.lit("unreviewed")).alias("state"))


def work_queue(coverage: DataFrame, last_done: DataFrame, key: str, when: str) -> DataFrame:
    """Incomplete owners, those longest untouched first (never touched before all)."""
    j = coverage.where("not complete").join(last_done, key, "left")
    return j.withColumn("position", F.row_number().over(Window.orderBy(F.col(when).asc_nulls_first(), key)).cast("long"))


def visible(rows: DataFrame, generation: int) -> DataFrame:
    """Rows of one generation; both bounds reach the scan."""
    return rows.where((F.col("gen_from") <= generation) & (F.col("gen_to").isNull() | (F.col("gen_to") > generation)))


def next_generation(rows: DataFrame, fresh: DataFrame, key: str, generation: int) -> DataFrame:
    """rows with the keys of ``fresh`` retired at ``generation`` and its rows added from then on."""
    keys = fresh.select(key).distinct().withColumn("_n", F.lit(True))
    old = rows.join(keys, key, "left").withColumn("gen_to", F.when(F.col("_n") & F.col("gen_to").isNull(), F.lit(generation).cast("long")).otherwise(F.col("gen_to"))).drop("_n")
    new = fresh.withColumn("gen_from", F.lit(generation).cast("long")).withColumn("gen_to", F.lit(None).cast("long"))
    return old.unionByName(new.select(*old.columns))


def compact(rows: DataFrame, oldest: int) -> DataFrame:
    """Without rows that no generation from ``oldest`` on sees."""
    return rows.where(F.col("gen_to").isNull() | (F.col("gen_to") > oldest))


def dirty(indexed: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, action: build, rebuild or remove."""
    j = indexed.select(key, F.col(fingerprint).alias("_i")).join(current.select(key, F.col(fingerprint).alias("_c")), key, "full_outer")
    a = F.when(F.col("_c").isNull(), "remove").when(F.col("_i").isNull(), "build").when(F.col("_i") != F.col("_c"), "rebuild")
    return j.select(key, a.alias("action")).where("action is not null")


def failures(log: DataFrame, key: str, at: str, now: Column, most: int = 2, spacing: int = 300) -> DataFrame:
    """key, attempts, last, retry_due of a failure log: under ``most`` attempts, ``spacing`` seconds apart."""
    g = log.groupBy(key).agg(F.count("*").alias("attempts"), F.max(at).alias("last"))
    due = (F.col("attempts") < most) & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp")) >= spacing)
    return g.withColumn("retry_due", due)


def transition(current: DataFrame, wanted: DataFrame, key: str, legal: DataFrame) -> DataFrame:
    """key, state, accepted: the wanted state where the step is legal, else the old one."""
    j = current.join(wanted, key).join(F.broadcast(legal.select(F.col("from_state").alias("state"), F.col("to_state").alias("to"), F.lit(True).alias("_ok"))), ["state", "to"], "left")
    ok = F.coalesce("_ok", F.lit(False))
    return j.select(key, F.when(ok, F.col("to")).otherwise(F.col("state")).alias("state"), ok.alias("accepted"))


def by_request(log: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """First row of each idempotency key with outcome: stored; later ones: replay if equal, else conflict."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(content).over(w)
    n = F.row_number().over(w)
    return log.withColumn("outcome", F.when(n == 1, "stored").when(F.col(content).eqNullSafe(first), "replay").otherwise("conflict"))


def plan_batches(rows: DataFrame, family: str, order: list[str], most: int = 12, least: int = 8) -> DataFrame:
    """batch (from 0, over all families in order) of every row: runs of a family, cut at ``most``; a run shorter than
    ``least`` joins the batch before it, whichever family that is of; without one it is a batch of its own.

    Inside a family this is arithmetic on the row's place; across families on one row each."""
    sizes = rows.groupBy(family).agg(F.count("*").alias("_size"))
    new = F.floor(F.col("_size") / most) + (F.col("_size") % most >= least).cast("int")
    w = Window.orderBy(F.col(family).asc_nulls_first())
    alone = (F.row_number().over(w) == 1) & (F.col("_size") < least)
    sizes = sizes.withColumn("_new", F.when(alone, 1).otherwise(new))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.select(F.col(family).alias("_family"), "_new", "_before")
    out = rows.join(sizes, F.col(family).eqNullSafe(F.col("_family")))
    place = F.row_number().over(Window.partitionBy(family).orderBy(*order)) - 1
    return out.withColumn("batch", (F.col("_before") + F.least(F.floor(place / most), F.col("_new") - 1)).cast("long")).drop("_family", "_new", "_before")


def retier(rows: DataFrame, family: str, tier: str, overrides: dict[str, str], default: str) -> DataFrame:
    """Rows whose tier changes, with new_tier: the family's override or the default."""
    new = F.coalesce(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[F.col(family)], F.lit(default))
    return rows.withColumn("new_tier", new).where(~F.col(tier).eqNullSafe(F.col("new_tier")))
