"""Integrity and census: anti and outer joins, coverage, duplicates, counts with empty classes, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def biconditional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of the keys that stand on one side only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").where("_l is null or _r is null")
    return both.select(key, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side"))


def uncovered(items: DataFrame, key: str, *covers: DataFrame) -> DataFrame:
    """Items that none of the covers holds."""
    for c in covers:
        items = items.join(c.select(key).distinct(), key, "left_anti")
    return items


def duplicates(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """key, first: rows whose content stands under a lesser key too. Partial aggregation finds the first; no group is gathered."""
    h = rows.select(key, F.sha2(content, 256).alias("_h")).where("_h is not null")
    first = h.groupBy("_h").agg(F.min(key).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    return h.join(first, "_h").where(F.col(key) > F.col("first")).select(key, "first")


def counts_with_empty(rows: DataFrame, column: str, classes: list[str], other: str = "undeclared") -> DataFrame:
    """class, n for every declared class (0 too) and one for all other values."""
    name = F.when(F.col(column).isin(classes), F.col(column)).otherwise(F.lit(other))
    n = rows.groupBy(name.alias("class")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(c,) for c in [*classes, other]], "class string")
    return every.join(n, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage(parts: DataFrame, done: DataFrame, owner: str, part: str) -> DataFrame:
    """owner, total, covered, complete: parts of each owner and how many are done."""
    seen = done.select(owner, part).distinct().withColumn("_d", F.lit(1))
    j = parts.join(seen, [owner, part], "left")
    out = j.groupBy(owner).agg(F.count("*").alias("total"), F.count("_d").alias("covered"))
    return out.withColumn("complete", F.col("total") == F.col("covered"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def gaps(rows: DataFrame, owner: str, number: str, start: int = 0) -> DataFrame:
    """Owners whose numbers are not start .. start + n - 1."""
    g = rows.groupBy(owner).agg(F.count("*").alias("n"), F.max(number).alias("last"), F.min(number).alias("first"))
    return g.where(f"first <> {start} or last - first + 1 <> n").select(owner, "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed, appended (the old value begins the new one), modified or unchanged."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    j = a.join(b, key, "full_outer")
    change = (
        F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged")
        .when(F.col("_b").startswith(F.col("_a")), "appended").otherwise("modified")
    )
    return j.select(key, change.alias("change"))


def percent_changed(changes: DataFrame, limit: float = 30.0) -> DataFrame:
    """total, changed, percent, escalate of a diff."""
    c = changes.agg(F.count("*").alias("total"), F.count_if(F.col("change") != "unchanged").alias("changed"))
    return c.withColumn("percent", F.round(F.when(F.col("total") > 0, 100.0 * F.col("changed") / F.col("total")).otherwise(0.0), 6)).withColumn("escalate", F.col("percent") > limit)


def difference(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows (with repeats) that the baseline lacks."""
    return rows.exceptAll(baseline)


def expected_and_seen(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, problem: missing, unknown or repeated in what was seen."""
    n = seen.groupBy(key).agg(F.count("*").alias("n"))
    j = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(n, key, "full_outer")
    p = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return j.select(key, p.alias("problem")).where("problem is not null")


def path_audit(events: DataFrame, owner: str, order: list[str], state: str, legal: DataFrame) -> DataFrame:
    """owner, from_state, to_state, n of steps that are not in ``legal`` (from_state, to_state)."""
    w = Window.partitionBy(owner).orderBy(*order)
    steps = events.select(owner, F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    bad = steps.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti")
    return bad.groupBy(owner, "from_state", "to_state").agg(F.count("*").alias("n"))


def unpivot_check(rows: DataFrame, key: str, fields: list[str], bad) -> DataFrame:
    """field, n of fields whose value fails a test."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.*")
    return long.where(bad(F.col("value"))).groupBy("field").agg(F.count("*").alias("n"))


def rule_rows(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for every rule that a row breaks; all rules in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))
