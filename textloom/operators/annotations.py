"""Annotations: who may have them, which count, the states and edges that follow from them, chunk sync, gated reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G

# Kinds of sources that are annotated; relations, and those that are a reading; review decisions; longest note.
ANNOTATED_KINDS = ("capture-text", "capture-media", "ingested-file")
RELATIONS = ("about", "mentions", "part_of_project", "related_to", "supports", "contradicts")
READINGS = ("supports", "contradicts")
DECISIONS = ("confirmed", "rejected")
LONGEST_NOTE = 1000
# Shapes of an entity, an artifact, a chunk and a public reference.
ENTITY, ARTIFACT, CHUNK, REF = r"^ent:[0-9a-f]{24}$", r"^art:.+", r"^chk:[0-9a-f]{32}$", r"^(rec|doc|cap):[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"


def policy(kind: Column) -> Column:
    return F.when(kind.isin(*ANNOTATED_KINDS), "annotate").otherwise("skip")


def usable(annotations: DataFrame, sources: DataFrame, key: str, version: str, review: str, body: str) -> DataFrame:
    """Annotations that may be indexed: with a body, not rejected, of the current version of their source or of no named one."""
    now = sources.select(key, F.col(version).alias("_now"))
    j = annotations.where((F.length(F.coalesce(body, F.lit(""))) > 0) & (F.coalesce(review, F.lit("")) != "rejected")).join(now, key)
    return j.where(F.col(version).isNull() | (F.col(version) == F.col("_now"))).drop("_now")


def states(sources: DataFrame, failures: DataFrame, annotations: DataFrame, key: str, version: str, has_text: str, stored: str) -> DataFrame:
    """key, state: failed, no_text, annotated, stale or projected; without a current version the stored state stays."""
    now = sources.select(key, F.col(version).alias("_now"), has_text, stored)
    noted = annotations.select(key, F.col(version).alias("_v")).distinct().join(now.select(key, "_now"), key)
    noted = noted.groupBy(key).agg(F.bool_or(F.col("_v").eqNullSafe(F.col("_now"))).alias("_current"))
    j = now.join(failures.select(key, F.lit(True).alias("_failed")).distinct(), key, "left").join(noted, key, "left")
    state = F.when(F.col("_failed"), "failed").when(F.col("_now").isNull(), F.col(stored)).when(~F.col(has_text), "no_text").when(F.col("_current"), "annotated")
    return j.select(key, state.when(F.col("_current").isNotNull(), "stale").otherwise("projected").alias("state"))


def chunk_sync(stored: DataFrame, fresh: DataFrame, annotated: DataFrame, owner: list[str], chunk: str, loose: list[str]) -> DataFrame:
    """owner, action of each owner (source and version) in ``fresh``: same; refresh, if only loose columns changed; replace, if
    the chunks did; refuse, if they did under an annotation."""
    a = stored.select(*owner, chunk, F.struct(*loose).alias("_a"), F.lit(True).alias("_in_a"))
    b = fresh.select(*owner, chunk, F.struct(*loose).alias("_b"), F.lit(True).alias("_in_b"))
    g = a.join(b, [*owner, chunk], "full_outer").groupBy(*owner).agg(
        F.bool_or(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("_differs"), F.bool_or(~F.col("_a").eqNullSafe(F.col("_b"))).alias("_changed"), F.max("_in_b").alias("_asked")
    )
    g = g.where("_asked").join(annotated.select(*owner, F.lit(True).alias("_noted")).distinct(), owner, "left")
    action = F.when(F.col("_differs") & F.col("_noted"), "refuse").when(F.col("_differs"), "replace").when(F.col("_changed"), "refresh").otherwise("same")
    return g.select(*owner, action.alias("action"))


def reviews(requests: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Requests (key, revision, decision, note, version or null) with outcome and audited, against (key, revision, version, stale).

    A request that is no valid one changes nothing and is not audited; every other leaves one audit row, recorded or not."""
    now = current.select(key, F.col("revision").alias("_revision"), F.col("version").alias("_version"), F.col("stale").alias("_stale"), F.lit(True).alias("_known"))
    j = requests.join(now, key, "left")
    note = F.trim(F.coalesce("note", F.lit("")))
    bad = ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)) | (note == "") | (F.length("note") > LONGEST_NOTE) | ~F.coalesce(F.col("revision") >= 1, F.lit(False))
    outcome = (
        F.when(bad, "bad_arguments").when(F.col("_known").isNull(), "not_found").when(F.col("_stale"), "stale_source").when(F.coalesce("_revision", F.lit(0)) == 0, "no_annotation")
        .when(F.col("_revision") != F.col("revision"), "conflict").when(F.col("version") != F.col("_version"), "stale_source").otherwise("recorded")
    )
    return j.withColumn("outcome", outcome).withColumn("audited", ~F.col("outcome").isin("bad_arguments", "not_found")).drop("_revision", "_version", "_stale", "_known")


def structural_edges(chunks: DataFrame, artifact: str, chunk: str, order: str, derived: DataFrame | None = None) -> DataFrame:
    """src, dst, kind: an artifact contains its chunks, a chunk leads to the next one, ``derived`` (artifact, text_ref) names derivatives."""
    c = chunks.withColumn("_next", F.lead(chunk).over(Window.partitionBy(artifact).orderBy(order)))
    parts = [(c, F.col(artifact), F.col(chunk), "contains"), (c, F.col(chunk), F.col("_next"), "next_chunk")]
    if derived is not None:
        parts.append((derived, F.col(artifact), F.col("text_ref"), "derived_from"))
    return G.edges(*parts)


def annotation_edges(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, relation, kind, evidence, revision of links (artifact, source_ref, src, dst, relation, evidence, revision).

    An empty end is the artifact; so is a chunk of its own, and its own reference. Links of an unknown relation or
    end go. The kind follows from the relation, whatever the caller says; evidence that is no chunk of the artifact
    is null, and a chunk that stood as an end takes its place. ``chunks`` are (artifact, chunk), once each."""
    j = links.where(F.col("relation").isin(*RELATIONS))
    for name in ("src", "dst", "evidence"):
        own = chunks.select(F.col("artifact").alias("_a"), F.col("chunk").alias(f"_{name}"))
        j = j.join(own, (F.col("artifact") == F.col("_a")) & (F.col(name) == F.col(f"_{name}")), "left").drop("_a")

    def end(name: str) -> Column:
        c, art = F.col(name), F.concat(F.lit("art:"), F.col("artifact"))
        plain = F.when(c.rlike(ENTITY) | c.rlike(ARTIFACT), c).when(c.rlike(REF), F.when(c == F.col("source_ref"), art).otherwise(c))
        return F.when(F.coalesce(c, F.lit("")) == "", art).when(c.rlike(CHUNK), F.when(F.col(f"_{name}").isNotNull(), art)).otherwise(plain)

    out = j.select(
        end("src").alias("src"), end("dst").alias("dst"), "relation", F.when(F.col("relation").isin(*READINGS), "reading").otherwise("semantic").alias("kind"),
        F.coalesce("_evidence", F.when(F.col("src").rlike(CHUNK), F.col("_src")), F.when(F.col("dst").rlike(CHUNK), F.col("_dst"))).alias("evidence"), "revision",
    )
    return out.where("src is not null and dst is not null")
