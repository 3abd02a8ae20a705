"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Largest inner product becomes least distance by one more component: with M the largest norm, row x is (x / M, sqrt(1 - |x|^2 / M^2)) and query q is (q / |q|, 0).
Each of several tables cuts K Gaussian projections into slots of width w; a cell is one slot of each. A query visits the T cells of a table that most likely hold a row at the
usual distance of a neighbour: the difference of two projections is normal with that distance as its deviation, so each slot has a chance, and the T best products are found by joining the
projections one after the other and keeping the T best prefixes (which is exact). What the tables' cells hold is merged and ranked by exact inner products of the original vectors.

Tables, K, w and T are fitted, never fixed by size: for a bounded sample of queries (SAMPLE) the true neighbours are found in a scan of all rows, and of all settings the one with the least work
that still finds TARGET of them is taken. All rows are indexed. Vectors without structure need most of the rows whatever the setting; the fit then comes near a scan.

Rows that share a vector are one row with its FEW + 1 smallest ids, as no list needs more; equal query vectors are answered once. So copies, however many, fill no cell.
Cells that share the first projections of a table are a group; groups are cut into blocks of bounded rows and bounded queries by hash, a query goes once to each block of a group it probes, and a
block sends the best FEW + 1 rows of each of its queries, never pairs. The rows are searched in rounds, a block of them first and then GROWTH times as many as before; from the second round on a block
sends of a query what is no worse than its FEW + 1 best so far. A round then adds some GROWTH lists to a query, so what is sent grows with the logarithm of the blocks, not with their number.
A query that finds too few rows is answered by an exact scan, in query blocks of bounded size; a task of a scan sends one list a query.

Vectors null, empty, zero or with null or non-finite components take no part, nor do rows of null id. Missing components of a shorter vector count as zero. Rows of one id: the least vector stays. Ties go to the smaller
id. An empty table, or none of its ids a query, gives an empty result. Extra columns are ignored. Reruns agree (seeds are fixed).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import quoted, saved

FEW = 20
#: Fitting: sampled queries and rows, the share of true neighbours to find, and what is tried.
SAMPLE, ROWS, TARGET = 64, 1024, 0.96
TABLES, MOST_HASHES = (2, 3, 4), 10
HASHES, WIDTHS, PROBES = (2, 4, 6, 8, 10), (1.0, 2.0, 3.0, 4.0), (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: Slots to each side of a query's own that are visited.
REACH = 3
#: Numbers of a block's rows, and its queries; queries of one exact scan.
BLOCK_NUMBERS, BLOCK_QUERIES, SCAN_QUERIES = 1 << 20, 2048, 512
#: Rows searched after a round, in times of those before it.
GROWTH = 4
LISTED = "array<struct<x: bigint, score: double, ids: array<bigint>>>"


@dataclass(frozen=True)
class Setting:
    tables: int
    hashes: int
    width: float
    probes: int
    distance: float
    prefix: int
    recall: float
    work: float


@dataclass(frozen=True)
class Space:
    """Scale and projections, the same on all machines: (numbers + 1) x (tables x MOST_HASHES)."""

    numbers: int
    norm: float

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.RandomState(17)
        n = TABLES[-1] * MOST_HASHES
        return r.standard_normal((self.numbers + 1, n)), r.random_sample(n)

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros(len(x))])


def vectors_of(column: pa.Array, numbers: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy().astype(np.int64))
    if (size == numbers).all():
        return flat.reshape(-1, numbers)
    out = np.zeros((len(size), numbers))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row: the same sum wherever a pair meets."""
    return (a * b).sum(axis=1)


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (a published rational approximation, off by less than 2e-7)."""
    t = 1 / (1 + 0.3275911 / math.sqrt(2) * np.abs(z))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z / 2)
    return 0.5 * (1 + np.sign(z) * (1 - tail))


def best_probes(within: np.ndarray, width: float, distance: float, most: int) -> np.ndarray:
    """Steps from each query's own cell, (queries, probes, projections), likeliest first; within: places inside the own slots."""
    steps = np.arange(-REACH, REACH + 1)
    low = (steps * width - within[:, :, None]) / distance
    chance = np.log(np.maximum(normal(low + width / distance) - normal(low), 1e-12))
    total, path = np.zeros((len(within), 1)), np.zeros((len(within), 1, 0), np.int8)
    for k in range(within.shape[1]):
        each = (total[:, :, None] + chance[:, k, None, :]).reshape(len(within), -1)
        pick = np.argpartition(-each, most, axis=1)[:, :most] if each.shape[1] > most else np.broadcast_to(np.arange(each.shape[1]), each.shape)
        pick = np.take_along_axis(pick, np.argsort(-np.take_along_axis(each, pick, 1), axis=1, kind="stable"), 1)
        total = np.take_along_axis(each, pick, 1)
        path = np.concatenate([np.take_along_axis(path, (pick // len(steps))[:, :, None], 1), steps[pick % len(steps)].astype(np.int8)[:, :, None]], axis=2)
    return path


def codes(slots: np.ndarray, table: int) -> np.ndarray:
    """One number for each row of slots; two cells of one number would only be searched together."""
    h = np.full(slots.shape[:-1], table + 1, np.uint64)
    for k in range(slots.shape[-1]):
        h = W.mix(h * np.uint64(31) + slots[..., k].astype(np.int64).astype(np.uint64))
    return h.view(np.int64)


def slots_of(projected: np.ndarray, offset: np.ndarray, table: int, hashes: int, width: float) -> np.ndarray:
    """Places on the axes of a table, in slots."""
    own = slice(table * MOST_HASHES, table * MOST_HASHES + hashes)
    return projected[:, own] / width + offset[own]


def probed(projected: np.ndarray, offset: np.ndarray, table: int, hashes: int, width: float, distance: float, most: int) -> np.ndarray:
    """The cells to visit, as slots (queries, probes, projections)."""
    at = slots_of(projected, offset, table, hashes, width)
    own = np.floor(at)
    return own[:, None, :] + best_probes((at - own) * width, width, distance, most)


def fit(queries: np.ndarray, rows: np.ndarray, near: list[np.ndarray], distance: float, offset: np.ndarray, total: int, block: int) -> Setting:
    """The setting of least work that finds TARGET of the sampled neighbours; all inputs are projections.

    work: rows scored in all tables, as a share of all rows."""
    best, spread, most = None, max(float(rows.std(axis=0).mean()), 1e-9), PROBES[-1]
    upto = np.cumsum([len(x) for x in near])
    every = np.concatenate(near)  # may be empty: one row has no neighbours
    for hashes in HASHES:
        for width in WIDTHS:
            found, seen = np.full(len(every), most), np.zeros((len(queries), len(PROBES)))
            for t in range(TABLES[-1]):
                cells = codes(probed(queries, offset, t, hashes, width * spread, distance, most), t)
                own_rows, own_near = (codes(np.floor(slots_of(x, offset, t, hashes, width * spread)), t) for x in (rows, every))
                for q, visit in enumerate(cells):
                    order = np.argsort(visit)
                    a, b = upto[q] - len(near[q]), upto[q]
                    for what, its in ((0, own_near[a:b]), (1, own_rows)):
                        at = np.minimum(np.searchsorted(visit[order], its), len(order) - 1)
                        rank = np.where(visit[order[at]] == its, order[at], most)
                        if what:
                            seen[q] += (rank[:, None] < np.array(PROBES)).mean(axis=0)
                        else:
                            found[a:b] = np.minimum(found[a:b], rank)
                if t + 1 in TABLES:
                    for p, probes in enumerate(PROBES):
                        recall, work = float((found < probes).mean()) if len(found) else 1.0, float(seen[:, p].mean())
                        key = (recall < TARGET, -recall if recall < TARGET else work, probes)
                        if best is None or key < best[0]:
                            best = (key, Setting(t + 1, hashes, width * spread, probes, distance, 0, recall, work))
                        if recall >= TARGET:
                            break
    s = best[1]
    prefix = 0
    for k in range(1, s.hashes + 1):  # groups of about a block of rows, as pairs of the sample share them
        _, many = np.unique(codes(np.floor(slots_of(rows, offset, 0, k, s.width)), 0), return_counts=True)
        if len(rows) < 2 or total * float((many * (many - 1)).sum()) / (len(rows) * (len(rows) - 1)) < block:
            break
        prefix = k
    return Setting(s.tables, s.hashes, s.width, s.probes, s.distance, prefix, s.recall, s.work)


def _best(q: np.ndarray, x: np.ndarray, ids: list[list[int]], keys: np.ndarray, few: int, floors: np.ndarray, open_: np.ndarray | None = None) -> Iterator[list[dict]]:
    """For each query the ``few`` best rows by (score, least id), scored exactly, that score no less than its floor; open_: which rows each query may see."""
    least = np.array([i[0] for i in ids], np.int64)
    for at in range(0, len(q), 128):
        part = q[at : at + 128]
        rough = part @ x.T
        if open_ is not None:
            rough = np.where(open_[at : at + 128], rough, -np.inf)
        slack = 1e-9 * np.maximum(1e-300, np.sqrt((part * part).sum(axis=1)) * (np.sqrt((x * x).sum(axis=1)).max() if len(x) else 0))
        for k in range(len(part)):
            row = rough[k]
            floor = max(floors[at + k], np.partition(row, len(row) - few)[len(row) - few] if len(row) > few else -np.inf)
            pick = np.flatnonzero((row >= floor - slack[k]) & (row > -np.inf))
            exact = scores(np.broadcast_to(part[k], (len(pick), x.shape[1])), x[pick])
            pick, exact = pick[exact >= floors[at + k]], exact[exact >= floors[at + k]]
            order = np.lexsort((least[pick], -exact))[:few]
            yield [{"x": int(keys[i]), "score": float(s), "ids": ids[i]} for i, s in zip(pick[order].tolist(), exact[order].tolist())]


_LISTS = pa.list_(pa.struct([("x", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))


def _scan(space: Space, queries):
    """Each task's best rows of a bounded set of queries: all pairs are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = queries.value
        lists: list[list[dict]] = [[] for _ in keys]
        for batch in batches:
            if batch.num_rows:
                x, floors = vectors_of(batch.column("v"), space.numbers), np.array([own[-1]["score"] if len(own) > FEW else -np.inf for own in lists])
                for k, more in enumerate(_best(q, x, batch.column("ids").to_pylist(), batch.column("x").to_numpy(), FEW + 1, floors)):
                    if more:
                        lists[k] = sorted(lists[k] + more, key=lambda f: (-f["score"], f["ids"][0]))[: FEW + 1]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, _LISTS)], names=["q", "found"])

    return run


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, query: Column) -> tuple[DataFrame, DataFrame]:
    """(x, v, ids, is_query: the distinct vectors with their least ids; id, v: the queries), both written."""
    v = F.col("v")
    rows = df.select(df[quoted(id_col)].cast("long").alias("id"), df[quoted(vector_col)].alias("v"), query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = saved(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")), "vectors")
    asked = rows.where("asked").select("id", "v")
    few = rows.select("id", "v", F.row_number().over(Window.partitionBy("v").orderBy("id")).alias("r")).where(F.col("r") <= FEW + 1)
    few = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = few.join(asked.select("v").distinct().withColumn("is_query", F.lit(True)), "v", "left")
    return saved(few.select(F.monotonically_increasing_id().alias("x"), "v", "ids", F.coalesce("is_query", F.lit(False)).alias("is_query")), "distinct"), asked


def _sampled(spark, vecs: DataFrame, space: Space, total: int, block: int) -> Setting:
    """Fits the setting: SAMPLE queries, their true neighbours among all rows, and ROWS rows; only projections are collected."""
    matrix, offset = space.matrix()
    by_hash = F.xxhash64(F.lit(5), F.col("x"))
    first = vecs.where("is_query").orderBy(by_hash, "x").limit(SAMPLE).select("x", "v").toArrow()
    keys, q = first.column("x").to_numpy(), vectors_of(first.column("v"), space.numbers)
    rows = vectors_of(vecs.orderBy(by_hash, "x").limit(ROWS).select("v").toArrow().column("v"), space.numbers)
    lists = vecs.mapInArrow(_scan(space, spark.sparkContext.broadcast((keys, q))), f"q long, found {LISTED}")
    near = _top(_flat(lists), FEW + 1).where("x != q").join(vecs.select("x", "v"), "x").select("q", "v").toArrow()
    owner, near_vectors = near.column("q").to_numpy(), vectors_of(near.column("v"), space.numbers)
    qs, ns = space.queries(q), space.rows(near_vectors)
    groups = [np.flatnonzero(owner == k) for k in keys.tolist()]
    apart = np.concatenate([np.sqrt(((ns[g] - qs[i]) ** 2).sum(axis=1)) for i, g in enumerate(groups)])
    return fit(qs @ matrix, space.rows(rows) @ matrix, [ns[g] @ matrix for g in groups], max(float(np.median(apart)) if len(apart) else 1.0, 1e-6), offset, total, block)


def _flat(lists: DataFrame) -> DataFrame:
    """q, x, score, ids: the rows of all lists."""
    return lists.select("q", F.explode("found").alias("f")).select("q", "f.*")


def _top(flat: DataFrame, few: int) -> DataFrame:
    """q, x, score, ids: the best ``few`` rows of each query."""
    flat = flat.groupBy("q", "x").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    return flat.withColumn("r", F.row_number().over(order)).where(F.col("r") <= few).drop("r")


def _row_cells(space: Space, s: Setting, vectors: bool):
    """A row's group and cell in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, offset = space.matrix()
        for batch in batches:
            p = space.rows(vectors_of(batch.column("v"), space.numbers)) @ matrix
            for t in range(s.tables):
                slots = np.floor(slots_of(p, offset, t, s.hashes, s.width))
                group = pa.array(codes(slots[:, : s.prefix], t))
                more = [batch.column("x"), batch.column("v"), batch.column("ids"), pa.array(codes(slots, t))] if vectors else []
                yield pa.RecordBatch.from_arrays([group, *more], names=["g", "x", "v", "ids", "cell"] if vectors else ["g"])

    return run


def _query_cells(space: Space, s: Setting, vectors: bool):
    """A query's groups, and the cells it visits in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, offset = space.matrix()
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                p = space.queries(vectors_of(batch.column("v"), space.numbers)) @ matrix
                for t in range(s.tables):
                    slots = probed(p, offset, t, s.hashes, s.width, s.distance, s.probes)
                    group, cell = codes(slots[:, :, : s.prefix], t), codes(slots, t)
                    owner = np.repeat(np.arange(batch.num_rows), group.shape[1])
                    order = np.lexsort((group.ravel(), owner))
                    o, g, c = owner[order], group.ravel()[order], cell.ravel()[order]
                    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)), pa.int32()), pa.array(c))
                    pick = pa.array(o[first])
                    more = [*(batch.column(c).take(pick) for c in ("x", "v", "floor")), lists] if vectors else []
                    yield pa.RecordBatch.from_arrays([pa.array(g[first]), *more], names=["g", "x", "v", "floor", "cells"] if vectors else ["g"])

    return run


def _block(space: Space):
    """The best rows of each query of a block among the cells it visits; no list without rows."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        keys: list[int] = []
        lists: list[list[dict]] = []
        if rows.num_rows and queries.num_rows:
            x, q = vectors_of(rows.column("v"), space.numbers), vectors_of(queries.column("v"), space.numbers)
            cell, cells = rows.column("cell").to_numpy(), queries.column("cells").combine_chunks()
            known, of = np.unique(cell, return_inverse=True)
            owner = np.repeat(np.arange(len(q)), np.diff(cells.offsets.to_numpy()))
            visit = cells.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, visit), len(known) - 1)
            hit = known[at] == visit
            visits = np.zeros((len(q), len(known)), np.bool_)
            visits[owner[hit], at[hit]] = True
            own = _best(q, x, rows.column("ids").to_pylist(), rows.column("x").to_numpy(), FEW + 1, queries.column("floor").to_numpy(), visits[:, of])
            for key, found in zip(queries.column("x").to_pylist(), own):
                if found:
                    keys.append(key)
                    lists.append(found)
        return pa.table({"q": pa.array(keys, pa.int64()), "found": pa.array(lists, _LISTS)})

    return run


def rounds(total: int, block: int) -> list[tuple[float, float]]:
    """Shares of the rows that each round begins and ends at: less than a block of rows, then GROWTH times as many."""
    ends = [1.0 if total <= block else 0.9 * block / total]
    while ends[-1] < 1:
        ends.append(min(1.0, ends[-1] * GROWTH))
    return list(zip([0.0, *ends], ends))


def _candidates(vecs: DataFrame, best: DataFrame | None, space: Space, s: Setting, block: int, low: float, high: float) -> DataFrame:
    """q, found: the lists of all blocks of the rows from share ``low`` to ``high``; best: (q, score) of the FEW + 1 best rows before."""
    asked = vecs.where("is_query").select("x", "v")
    number = vecs.schema["v"].dataType
    share = F.pmod(F.xxhash64(F.lit(23), "x"), F.lit(1 << 30)) / (1 << 30)
    tall = vecs.where((share >= low) & (share < high)).select("x", "v", "ids")
    worst = F.lit(float("-inf"))
    if best is None:
        asked = asked.withColumn("floor", worst)
    else:
        floors = best.groupBy("q").agg(F.when(F.count(F.lit(1)) > FEW, F.min("score")).alias("floor"))
        asked = asked.join(floors, F.col("x") == F.col("q"), "left").select("x", "v", F.coalesce("floor", worst).alias("floor"))
    sizes = tall.mapInArrow(_row_cells(space, s, False), "g long").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("rp"))
    loads = asked.mapInArrow(_query_cells(space, s, False), "g long").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("qp"))
    parts = saved(sizes.join(loads, "g"), "groups")
    field = lambda n, t: T.StructField(n, t)
    longs = T.ArrayType(T.LongType())
    rows = tall.mapInArrow(_row_cells(space, s, True), T.StructType([field("g", T.LongType()), field("x", T.LongType()), field("v", number), field("ids", longs), field("cell", T.LongType())]))
    probes = asked.mapInArrow(_query_cells(space, s, True), T.StructType([field("g", T.LongType()), field("x", T.LongType()), field("v", number), field("floor", T.DoubleType()), field("cells", longs)]))
    split = lambda n: F.pmod(F.xxhash64("x"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = rows.join(parts, "g").select("g", split("rp").alias("a"), every("qp").alias("b"), "x", "v", "ids", "cell")
    probes = probes.join(parts, "g").select("g", every("rp").alias("a"), split("qp").alias("b"), "x", "v", "floor", "cells")
    return rows.groupBy("g", "a", "b").cogroup(probes.groupBy("g", "a", "b")).applyInArrow(_block(space), f"q long, found {LISTED}")


def _lists(top: DataFrame) -> DataFrame:
    """q, near: ids with scores, nearest first, one more than asked for."""
    flat = top.select("q", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    flat = flat.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FEW + 1)
    return flat.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))


def search(df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Setting | None]:
    """(query_id, rank, id_col, score: the FEW nearest found of each row for which ``query`` holds; the fitted setting)."""
    spark = df.sparkSession
    vecs, asked = distinct_vectors(df, id_col, vector_col, query)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, numbers, norm, queries, ids = vecs.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.sqrt(norm2)), F.count(F.when(F.col("is_query"), 1)), F.sum(F.size("ids"))).first()
    if not queries:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double"), None
    space, block = Space(numbers, norm), max(256, BLOCK_NUMBERS // numbers)
    setting = _sampled(spark, vecs, space, total, block)
    best = None
    for low, high in rounds(total, block):  # the first rows are one block in each table, whatever the groups of all rows
        flat = _flat(_candidates(vecs, best, space, setting if low else replace(setting, prefix=0), block, low, high))
        best = saved(_top(flat if best is None else flat.unionByName(best), FEW + 1), "best")
    near = saved(_lists(best), "near")
    short = near.where(F.size("near") >= min(FEW + 1, ids)).select("q")
    short = saved(vecs.where("is_query").select("x", "v").join(short, F.col("x") == F.col("q"), "left_anti"), "short")
    left = short.count()
    if left:  # too few found: an exact scan, block after block
        near = near.join(short, F.col("q") == F.col("x"), "left_anti")
        blocks = -(-left // SCAN_QUERIES)
        for k in range(blocks):
            own = short.where(F.pmod(F.xxhash64("x"), F.lit(blocks)) == k).toArrow()
            if own.num_rows:
                held = spark.sparkContext.broadcast((own.column("x").to_numpy(), vectors_of(own.column("v"), numbers)))
                near = near.unionByName(saved(_lists(_top(_flat(vecs.mapInArrow(_scan(space, held), f"q long, found {LISTED}")), FEW + 1)), "scanned"))
    lists = vecs.where("is_query").select("x", "v").join(near, F.col("x") == F.col("q")).select("v", "near")
    out = asked.join(lists, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, FEW).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias(id_col), F.col("n.score").alias("score")), setting
