"""Requests as rows: checked, their identifiers shaped as phrases, the references they name, the pages they resume.

All but a page's token are column expressions, so any number of requests is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys and scopes of a request, bounds of its numbers (default, least, most), longest texts.
KEYS = ("query", "scope", "limit", "budget_tokens", "cursor")
SCOPES = ("canonical", "captures", "all")
NUMBERS = {"limit": (10, 1, 50), "budget_tokens": (4000, 500, 16000)}
LONGEST_QUERY, LONGEST_CURSOR = 1000, 2048
# References and bare identifiers in a query, and what joins the parts of an identifier.
TYPED = r"((?<![A-Za-z0-9_-])(?:(?:rec|doc|cap):[A-Za-z0-9][A-Za-z0-9_-]{0,127}|chk:[0-9a-f]{32}))"
BARE = r"((?<![A-Za-z0-9_:-])[A-Za-z0-9][A-Za-z0-9_-]{4,127}(?![A-Za-z0-9_-]))"
CAPTURE = r"^cap-\d{8}-\d{6}-[0-9a-f]{4}\z"
JOINED = r"[-_./:]+"


def checked(rows: DataFrame, key: str, request: str, numbers: dict[str, tuple[int, int, int]] = NUMBERS) -> DataFrame:
    """key, error, wrong, query, scope, the numbers, cursor of requests given as JSON texts.

    error: E_BAD_ARGUMENTS (no object, or values of a wrong type or range), E_UNKNOWN_ARGUMENT (keys that a request has not); ``wrong`` names the keys. Values of a good request
    come trimmed and with defaults, of a refused one as nulls."""
    df = rows.select(rows[f"`{key}`"].alias("_key"), F.try_parse_json(F.col(request)).alias("v"), F.json_object_keys(request).alias("keys"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    given = lambda k: F.array_contains("keys", k)
    is_text = lambda k: kind(k) == "STRING"
    whole = lambda k: F.when(kind(k) == "BIGINT", F.try_variant_get("v", f"$.{k}", "long"))
    good = {
        "query": is_text("query") & (F.trim(text("query")) != "") & (F.length(text("query")) <= LONGEST_QUERY), "scope": ~given("scope") | (is_text("scope") & text("scope").isin(*SCOPES)),
        "cursor": ~given("cursor") | (kind("cursor") == "VOID") | (is_text("cursor") & F.length(text("cursor")).between(1, LONGEST_CURSOR)),
    } | {k: ~given(k) | whole(k).between(least, most) for k, (_, least, most) in numbers.items()}
    strange = F.array_except("keys", F.array(*map(F.lit, KEYS)))
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in good.items()]))
    df = df.withColumns({"strange": F.array_sort(strange), "bad": F.when(F.col("keys").isNotNull(), bad)})
    error = F.when(F.col("keys").isNull(), "E_BAD_ARGUMENTS").when(F.size("strange") > 0, "E_UNKNOWN_ARGUMENT").when(F.size("bad") > 0, "E_BAD_ARGUMENTS")
    df = df.withColumn("error", error)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return df.select(
        F.col("_key").alias(key), "error", F.when(F.col("keys").isNull(), "").when(F.size("strange") > 0, F.array_join("strange", ",")).otherwise(F.array_join("bad", ",")).alias("wrong"),
        fine(F.trim(text("query"))).alias("query"), fine(F.coalesce(text("scope"), F.lit("all"))).alias("scope"), *[fine(F.coalesce(whole(k), F.lit(v[0]))).alias(k) for k, v in numbers.items()], fine(text("cursor")).alias("cursor"),
    )


def phrases(query: Column) -> Column:
    """Identifiers outside quotes (``report-1402.pdf``) as quoted phrases of their parts; negated words and prefixes stay as they are.

    The query is taken as runs: quoted ones, and words with the blanks before them."""
    run = r'( *)("[^"]*"|[^ "]+)'
    blanks, words = (F.regexp_extract_all(query, F.lit(run), k) for k in (1, 2))

    def shaped(word: Column) -> Column:
        parts = F.filter(F.split(word, JOINED), lambda p: p != "")
        phrase = F.when(F.size(parts) > 1, F.concat(F.lit('"'), F.array_join(parts, " "), F.lit('"'))).when(F.size(parts) == 1, F.array_join(parts, "")).otherwise(word)
        return F.when(word.rlike(r'^["-]') | word.contains("*") | ~word.rlike(r"(?U)\w[-_./:]\w"), word).otherwise(phrase)

    return F.trim(F.array_join(F.zip_with(blanks, words, lambda b, w: F.concat(F.when(b == "", "").otherwise(" "), shaped(w))), ""))


def references(query: Column) -> Column:
    """References in a query, once each: typed ones as they stand, then bare identifiers with a hyphen as captures or records."""
    typed = F.regexp_extract_all(query, F.lit(TYPED), 1)
    bare = F.filter(F.regexp_extract_all(query, F.lit(BARE), 1), lambda w: w.contains("-") & ~F.array_contains(typed, w))
    return F.array_distinct(F.concat(typed, F.transform(bare, lambda w: F.concat(F.when(w.rlike(CAPTURE), "cap:").otherwise("rec:"), w))))


def page(rows: DataFrame, key: str, size: int, generation: int = 0, token: str | None = None) -> tuple[DataFrame, str | None]:
    """(the next ``size`` rows by key, the token of the page behind them; None at the end).

    A token holds the last key, as JSON of the key's own type, and the generation of the rows; one of another generation is refused, and the
    key's filter reaches the scan."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    schema = f"g long, after {kind}"
    if token is not None:
        state = spark.range(1).select(F.from_json(F.try_to_binary(F.lit(token), F.lit("base64")).cast("string"), schema).alias("s")).first()["s"]
        if state is None or state["after"] is None or state["g"] != generation:
            raise ValueError("no token of these rows")
        rows = rows.where(F.col(key) > F.lit(state["after"]))
    cut = rows.where(F.col(key).isNotNull()).orderBy(key).limit(size)
    last = cut.agg(F.count(F.lit(1)).alias("n"), F.base64(F.to_json(F.struct(F.lit(generation).cast("long").alias("g"), F.max(key).alias("after"))).cast("binary")).alias("t")).first()
    return cut, last["t"] if last["n"] == size else None
