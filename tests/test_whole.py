"""Queries that take whole tables leave no row out."""

from pyspark.sql import functions as F

from textloom.operators import evidence as E
from textloom.plans import catalog
from textloom.plans.search_queries import TERMS


def test_chronology_has_every_event(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    got = catalog.QUERIES["chronology"](spark, data)
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert got.select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_tei_export_has_every_whole_text(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    plain = F.replace(F.replace(F.replace(F.regexp_extract("tei", "(?s)<p>(.*)</p></body></text></TEI>$", 1), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    got = catalog.QUERIES["tei_export"](spark, data).select("doc_id", plain.alias("t"))
    assert got.count() == d.count() and got.join(d, "doc_id").where("t <> text").count() == 0


def test_heading_escapes_and_first_json_object_have_every_row(spark, data):
    got = catalog.QUERIES["heading_escapes"](spark, data)
    assert got.count() == got.where("done").count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert catalog.QUERIES["first_json_object"](spark, data).where("found is not null").count() == spark.read.parquet(f"{data}/events.parquet").where("props is not null").count()


def test_fallback_fills_up_behind_many_long_hits(spark, data, tmp_path):
    rows = [(i, " ".join(TERMS) + " long" * 300) for i in range(1000)] + [(i, "none here") for i in range(1000, 1060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["fallback_supplement"](spark, str(tmp_path)).where("route = 2").collect()
    assert sorted(r.doc_id for r in got) == list(range(1000, 1050))


def test_verbatim_finds_quotes_without_an_inner_word(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 2
    quotes = [(1, "incomprehensibility characteristically"), (2, long[3:30]), (3, "-" * 20), (4, "zzzzzzzzzz" * 2), (5, "the inner word of this one is found"), (5, long[5:25])]
    texts = [(k, "é" * k + " " + t) for k in range(12) for t in [f"an incomprehensibility characteristically so {long} and {'-' * 25}\nthe inner word of this one is found"]]
    want = sorted((q, k, t.index(s) + 1) for q, s in quotes for k, t in texts if s in t)
    assert len(want) == 60
    for held in (0, 1000):  # met on words and blocks; in one pass
        got = E.verbatim(spark.createDataFrame(quotes, "q long, quote string"), "q", "quote", spark.createDataFrame([*texts, (99, None)], "id long, text string"), "id", "text", held).collect()
        assert sorted((r.q, r.id, r["at"]) for r in got) == want
