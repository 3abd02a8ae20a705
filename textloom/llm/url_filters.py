"""URL filters by association rules.

Urls are sets of tokens: host labels with their depth, path parts with theirs (as they are, and with digits
as zeros), the first digit of a part, query keys, scheme and fragment. Labels come from explicit (host, path)
rules, of which the longest that fits wins. Spark's FP-growth mines token combinations with the label among
the items, from labelled urls alone; combinations whose label has enough confidence among them, enough
support and enough lift over all urls become rules, rules that a shorter one implies are pruned, and an
inverted index from each rule's rarest token finds the rules of a url. A url that no explicit rule fits gets
the verdict of the best mined rule, or allow.

FP-growth lists every combination, so baskets are made short first, without losing a rule that would stay:
tokens below the support are in no rule; tokens of one and the same set of urls (equal counts and equal sums of
row hashes) are one item; a token whose urls all have one label, with enough lift, is a rule of its own, which
prunes every longer one, so it is not mined again. Of what is left FP-growth gets the WIDTH most telling tokens of
a url, or fewer if it would list over MAX_RULES rules. What it then can't see are sets that some url of more tokens
holds; those are mined level by level (``_longer``). Only sets that each lesser one exceeds in urls are extended, as
any other set has a part with the same counts, which prunes it; so nested urls, of whatever depth, add no combinations.
Confidence, support and lift of every rule are counted anew over all urls. No combination of tokens is left out. The
number of sets grows with the tokens a url has and with one in ``min_support``, not with the urls.

Null urls and urls without ``://`` have empty host and path, no tokens, and are allowed. Without labelled urls
nothing is mined. Equally good rules: the one with more urls, then the one that sorts last. Repeated rows get
equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Fixed values: (verdict, host, path) rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Share of a rule's urls that have its label, over the share of all urls that have it.
MIN_LIFT = 1.5
MAX_RULES = 50_000
WIDTH = 10
_LABEL = "label="


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds _host and _path."""
    at = F.coalesce(F.locate("://", F.col(url_col)), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.expr("substring(_rest, length(_raw) + 1)")
    df = pages.withColumn("_rest", rest).withColumn("_raw", host)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = df.withColumn("_scheme", F.when(at > 0, F.lower(F.expr(f"substring(`{url_col}`, 1, locate('://', `{url_col}`) - 1)"))).otherwise(F.lit("")))
    return df.withColumn("_host", F.translate("_raw", upper, lower)).withColumn("_path", F.regexp_extract(tail, "^[^?#]*", 0)).withColumn("_after", F.expr("substring(_rest, length(_raw) + length(_path) + 1)"))


def explicit(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds _rule (host then path, or null) and _verdict of the longest rule that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("_host") == host) | F.col("_host").endswith("." + host)) & F.col("_path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumns({"_rule": rule, "_verdict": verdict})


def tokens():
    """Distinct tokens of a parsed url."""
    labels = F.expr("array_remove(split(_host, '\\\\.'), '')")
    parts = F.expr("filter(split(_path, '/'), x -> x <> '')")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), (F.size(labels) - i).cast("string"), F.lit("="), x))
    paths = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), x))
    shapes = F.transform(parts, lambda x, i: F.when(x.rlike("[0-9]"), F.concat(F.lit("s"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "0"))))
    lead = F.transform(parts, lambda x, i: F.when(x.rlike("^[0-9]"), F.concat(F.lit("d"), i.cast("string"), F.lit("="), F.substring(x, 1, 1))))
    keys = F.transform(F.regexp_extract_all("_after", F.lit("[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q="), x))
    rest = F.when(F.col("_host") != "", F.array(F.concat(F.lit("u="), F.col("_scheme")), F.when(F.col("_after").contains("#"), F.lit("f="))))
    return F.array_distinct(F.array_compact(F.concat(hosts, paths, shapes, lead, keys, F.coalesce(rest, F.array().cast("array<string>")))))


def _counted(rows: DataFrame, rules: list[tuple[frozenset, str]]) -> dict[tuple[frozenset, str], tuple[int, int, int]]:
    """(urls of the label, labelled urls, urls) that hold each rule's tokens, over all rows (_items, _verdict)."""
    sent = rows.sparkSession.sparkContext.broadcast(inverted([(body, label, 0.0, 0, k) for k, (body, label) in enumerate(rules)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n = sent.value, np.zeros((len(rules), 3), np.int64)
        for batch in batches:
            for items, verdict in zip(batch.column("_items").to_pylist(), batch.column("_verdict").to_pylist()):
                own = set(items or ())
                for t in own:
                    for body, label, _, _, k in index.get(t, ()):
                        if body <= own:
                            n[k] += (verdict == label, verdict is not None, 1)
        some = np.flatnonzero(n[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(n[some, c], pa.int64()) for c in range(3)]], names=["k", "a", "b", "c"])

    out = rows.select("_items", "_verdict").mapInArrow(run, "k long, a long, b long, c long").groupBy("k").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
    return {rules[r[0]]: (r[1], r[2], r[3]) for r in out}


def _extended(baskets: DataFrame, sets: list[tuple], least: int) -> list:
    """Rows (s, block, allow, c, cut): the sets that are one of ``sets`` and one later token, with enough urls of a label, at least one of them cut."""
    tree: dict = {}
    for own in sets:
        node = tree
        for t in own:
            node = node.setdefault(t, {})
        node[None] = True
    sent = baskets.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sent.value

        def told(n: dict) -> pa.RecordBatch:
            cols = [pa.array([v[k] for v in n.values()], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.list_(pa.int32())), *cols], names=["s", "block", "allow", "c", "cut"])

        for batch in batches:
            n: dict[tuple, list[int]] = {}
            for own, verdict, cut in zip(*(batch.column(c).to_pylist() for c in ("own", "_verdict", "cut"))):
                add, walk = (verdict == "block", verdict == "allow", 1, cut), [(whole, (), 0)]
                while walk:
                    node, body, at = walk.pop()
                    for j in range(at, len(own)):
                        t = own[j]
                        if None in node:
                            have = n.setdefault((*body, t), [0, 0, 0, 0])
                            for k in range(4):
                                have[k] += add[k]
                        if t in node:
                            walk.append((node[t], (*body, t), j + 1))
                if len(n) > MAX_RULES:
                    yield told(n)
                    n = {}
            yield told(n)

    out = baskets.mapInArrow(run, "s array<int>, block long, allow long, c long, cut long").groupBy("s").agg(*[F.sum(c).alias(c) for c in ("block", "allow", "c", "cut")])
    return out.where((F.greatest("block", "allow") >= least) & (F.col("cut") > 0)).collect()


def _longer(rows: DataFrame, rank, width: int, holds, least: int) -> list[tuple[frozenset, str]]:
    """(tokens, label) of the rules whose tokens some labelled url of over ``width`` ranked tokens holds; holds(label, a, b, c): whether it is one.

    Level by level; a set is extended if each lesser one has more urls and no rule of its own is sure, as other sets' extensions are pruned."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = rank.value
        for batch in batches:
            verdict = batch.column("_verdict")
            own = [sorted(at[i] for i in set(items or ()) if i in at) for items in batch.column("_items").to_pylist()]
            cut = [v is not None and len(x) > width for v, x in zip(verdict.to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), verdict, pa.array(cut, pa.bool_())], names=["own", "_verdict", "cut"])

    baskets = saved(rows.mapInArrow(ranked, "own array<int>, _verdict string, cut boolean"), "ranked")
    if baskets.where("cut").isEmpty():
        return []
    names, out, before = list(rank.value), [], {(): -1}
    while before:
        keys, level = list(before), {}
        for k in range(0, len(keys), MAX_RULES):
            for r in _extended(baskets, keys[k : k + MAX_RULES], least):
                body = tuple(r.s)
                parts = [body[:i] + body[i + 1 :] for i in range(len(body))]
                if all(x in before and before[x] != r.c for x in parts):
                    rules = {v: a for v, a in (("allow", r.allow), ("block", r.block)) if a >= least and holds(v, a, r.allow + r.block, r.c)}
                    out += [(frozenset(names[t] for t in body), v) for v in rules]
                    if r.allow + r.block not in rules.values():
                        level[body] = r.c
        before = level
    return out


def mine(df: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> list[tuple[frozenset, str, float, int]]:
    """(tokens, verdict, confidence, count) rules of a table with _items and _verdict (null where unknown)."""
    from pyspark.ml.fpm import FPGrowth

    spark = df.sparkSession
    rows = saved(df.select("_items", "_verdict"), "baskets")
    known = rows.where("_verdict is not null")
    totals = {r[0]: r[1] for r in rows.groupBy("_verdict").count().collect()}
    n, total = sum(c for v, c in totals.items() if v is not None), sum(totals.values())
    if not n:
        return []
    least = max(2, int(n * min_support))
    holds = lambda label, a, b, c: a >= min_confidence * b and a * total >= min_lift * totals.get(label, 0) * c
    # one row a token with enough support: at most (tokens a url) / min_support of them
    numbered = rows.withColumn("_r", F.xxhash64(F.monotonically_increasing_id()))
    stats = numbered.select(F.explode("_items").alias("t"), "_verdict", "_r").groupBy("t").agg(
        F.count("_verdict").alias("n"), F.count("*").alias("c"), F.bit_xor("_r").alias("x"), F.bit_xor(F.xxhash64("_r")).alias("y"), F.sum((F.col("_verdict") == "block").cast("int")).alias("blocked"),
    ).where(F.col("n") >= least).collect()
    found, sets = [], {}
    for r in stats:
        pure = "block" if r.blocked == r.n else "allow" if not r.blocked else None
        found += [(frozenset([r.t]), v) for v in ([pure] if pure else ["allow", "block"])]
        if not pure or r.n * total < min_lift * totals[pure] * r.c:
            sets.setdefault((r.c, r.x, r.y), []).append((r.t, abs(r.blocked / r.c - totals.get("block", 0) / total)))
    mixed = {min(ts)[0]: ts[0][1] for ts in sets.values()}
    if mixed:
        # tokens by how telling they are, so that the first of a url are its most telling ones
        rank = spark.sparkContext.broadcast({t: k for k, t in enumerate(sorted(mixed, key=lambda t: (-mixed[t], t)))})

        def baskets(width: int) -> DataFrame:
            def basket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                at = rank.value
                for batch in batches:
                    out = [sorted((i for i in items if i in at), key=at.get)[:width] + [_LABEL + v] for items, v in zip(batch.column("_items").to_pylist(), batch.column("_verdict").to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["items"])

            return known.mapInArrow(basket, "items array<string>")

        width = WIDTH
        while True:
            # a little less than both limits, which are held against exact counts below
            model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence - 1e-9).fit(baskets(width))
            rules = saved(model.associationRules.where(F.col("consequent")[0].startswith(_LABEL)).select("antecedent", F.col("consequent")[0].alias("label")), "rules")
            if rules.count() <= MAX_RULES or width == 1:
                break
            width //= 2  # what longer ones hold is left to _longer
        found += [(frozenset(r.antecedent), r.label[len(_LABEL) :]) for r in rules.collect()]
        found += _longer(rows, rank, width, holds, least)
    found = sorted(set(found), key=lambda r: (sorted(r[0]), r[1]))
    out = []
    for k in range(0, len(found), MAX_RULES):
        for (body, label), (a, b, c) in _counted(rows, found[k : k + MAX_RULES]).items():
            if a >= least and holds(label, a, b, c):
                out.append((body, label, a / b, a))
    # a rule that a part of it already makes, at no less confidence, is pruned
    out.sort(key=lambda r: (len(r[0]), -r[2], -r[3], sorted(r[0])))
    kept: list = []
    by_token: dict[str, list] = {}
    for r in out:
        if not any(k[0] < r[0] and k[1] == r[1] and k[2] >= r[2] for t in r[0] for k in by_token.get(t, ())):
            kept.append(r)
            by_token.setdefault(min(r[0]), []).append(r)
    return kept


def inverted(rules: list) -> dict[str, list]:
    """Rules under the token that the fewest rules have, best first."""
    use: dict[str, int] = {}
    for body, *_ in rules:
        for t in body:
            use[t] = use.get(t, 0) + 1
    index: dict[str, list] = {}
    for r in sorted(rules, key=lambda r: (-r[2], -r[3], sorted(r[0]))):
        index.setdefault(min(r[0], key=lambda t: (use[t], t)), []).append(r)
    return index


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that decided; else null)."""
    spark = pages.sparkSession
    df = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    df = explicit(parsed(df, "_url"), rules).withColumn("_items", tokens())
    mined = mine(df, min_support, min_confidence, min_lift)
    sent = spark.sparkContext.broadcast(inverted(mined))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            verdicts, sure = [], []
            for items, verdict in zip(batch.column("_items").to_pylist(), batch.column("_verdict").to_pylist()):
                best = None
                if verdict is None:
                    own = set(items or ())
                    fits = [r for t in own for r in index.get(t, ()) if r[0] <= own]
                    best = max(fits, key=lambda r: (r[2], r[3], sorted(r[0])), default=None)
                verdicts.append(verdict or (best[1] if best else "allow"))
                sure.append(best[2] if best else None)
            keep = [f.name for f in batch.schema if f.name not in ("_items", "_verdict")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(verdicts, pa.string()), pa.array(sure, pa.float64())], names=[*keep, "verdict", "confidence"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = df.select(F.col("_id").alias("id"), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), "_items", "_verdict")
    return rows.mapInArrow(match, f"id {kind}, host string, path string, rule string, verdict string, confidence double").withColumnRenamed("id", id_col)
