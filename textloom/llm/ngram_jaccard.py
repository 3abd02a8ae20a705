"""N-gram Jaccard join by a token-group matrix.

1. Each document becomes its set of 5-word shingles (64-bit hashes). Documents of equal sets fall into
   one class by a 128-bit digest; the least id stands for it, so exact copies cost one row each.
2. Grouping: representatives that share one of two least hashes are compared with one such representative
   (the least, or the last) and with a few others that come by, and the links found partition similar
   documents into groups (a bounded number of comparisons a document).
3. A prefix filter orders shingles by a bounded frequency sketch, rarest first: two sets of similarity t share
   a shingle among the first n - ceil(t n) + 1 of each. Groups, and documents of small groups by the last token of
   their prefix (the one that most others share), are split into blocks of BLOCK documents, or of the square root
   of a larger home's size. Prefix tokens that several classes have enter the matrix of (token, block). A token
   whose documents lie in one group opens nothing.
4. The matrix bounds what documents of two blocks can share: sizes must allow t, and enough tokens of one
   block's union must stand in the other's. Blocks that qualify are opened: a document's whole overlap with a
   block's whole union must reach ceil(t n), and then sets are compared one by one.
5. Links of steps 2 and 4 give components. Links inside one group are not repeated: they can't change a
   component; every other link between different sets is found.

No key fills a task: keys that many rows share are joined by broadcast (``hot_join``), the documents of a pivot
or block are dealt over as many tasks as they need, each with its own copy of the pivot or block. A family of M
documents that share a token and do not link mostly shares its home too, so it lies in some sqrt(M) blocks and
makes some M rows.

Null or empty texts have the empty set and link with nothing. A document of fewer words than a shingle
is one shingle of its whole sequence. Repeated rows share a class. A row of null id gets the component
of its class (null if all its ids are null). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components, hot_join
from .store import quoted, saved

SHINGLE = 5
PERCENT = 80
#: Counters of the frequency sketch, whatever the input's size: they only order tokens.
SKETCH_BITS = 22
SLICES = 64
BLOCK = 64
#: Documents that meet one copy of a pivot or a block.
MEET = 64
#: Address bits at most of the bitmap of tokens that several classes share, which has some 32 bits a token.
LIVE_BITS = 28


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    ws = W.tokenize(texts, W.SPACED, lower=True)
    hashes = ws.hashes()
    found, at = ws.windows(hashes, size)
    first = np.searchsorted(at, ws.first)
    short = {}
    for n in range(1, size):
        few = np.flatnonzero(ws.counts == n)
        if len(few):
            short |= dict(zip(few.tolist(), W.mix(W.runs(hashes, n)[ws.first[few]] + np.uint64(n))[:, None]))
    for d in range(len(texts)):
        yield short[d] if d in short else np.unique(found[first[d] : first[d + 1]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (part null), then this task's sketch in slices."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["id", "n", "d1", "d2", "k1", "k2", "part", "counts"]
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("_id").type
        for piece in W.pieces(batch, "_text"):
            sets = list(shingle_sets(piece.column("_text")))
            cells, times = np.unique((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
            sketch[cells] += times.astype(np.uint32)
            n = np.array([len(s) for s in sets])
            salt = np.uint64(0x9E3779B97F4A7C15)
            total = lambda f: np.array([int(f(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
            least = lambda f: np.array([int(f(s).min()) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
            cols = [piece.column("_id"), n, total(W.mix), total(lambda s: W.mix(s ^ salt)), least(lambda s: s), least(lambda s: W.mix(s + salt))]
            yield pa.RecordBatch.from_arrays([cols[0], *[pa.array(c, pa.int64()) for c in cols[1:]], pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
    step = len(sketch) // SLICES
    counts = [np.minimum(sketch[i * step : (i + 1) * step], 255).astype(np.uint8).tobytes() for i in range(SLICES)]
    nulls = [pa.nulls(SLICES, kind)] + [pa.nulls(SLICES, pa.int64())] * 5
    yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(SLICES), pa.int32()), pa.array(counts, pa.binary())], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that this task was dealt, one running array a slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts")):
            add = np.frombuffer(raw.as_buffer(), np.uint8).astype(np.uint32)
            sums[part] = sums[part] + add if part in sums else add
    keys = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([np.minimum(sums[k], 65535).astype("<u2").tobytes() for k in keys], pa.binary())], names=["part", "counts"])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _firsts(texts: pa.Array, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set and its prefix: the rarest shingles, rarest first."""
    for s in shingle_sets(texts):
        rarest = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
        yield s, s[rarest[: min(len(s), prefix_length(len(s)))]]


def _prefixes(sketch):
    """(token, d1) of each document's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, "<u2")
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                sets, tokens = zip(*_firsts(piece.column("_text"), counts))
                whole = np.array([int(W.mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64), pa.int64()), pa.array(np.repeat(whole, [len(t) for t in tokens]), pa.int64())], names=["token", "d1"])

    return run


def _entries(sketch, live, width: int):
    """(token, id, n) of the tokens of each document's prefix that ``live`` knows, and of its last one with n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bits = np.frombuffer(sketch.value, "<u2"), np.frombuffer(live.value, np.uint8)
        for batch in batches:
            for piece in W.pieces(batch, "_text"):
                tokens, size, lengths = [], [], np.zeros(piece.num_rows, np.int64)
                for d, (s, first) in enumerate(_firsts(piece.column("_text"), counts)):
                    if len(s):
                        cell = first >> np.uint64(64 - width)
                        known = first[(bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                        tokens += [known, first[-1:]]
                        size += [np.full(len(known), len(s)), np.zeros(1, np.int64)]
                        lengths[d] = len(known) + 1
                if tokens:
                    owner = pa.array(np.repeat(np.arange(piece.num_rows), lengths))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64), pa.int64()), piece.column("_id").take(owner), pa.array(np.concatenate(size), pa.int32())], names=["token", "id", "n"])

    return run


def _live_tokens(tokens: DataFrame):
    """Broadcast bitmap of the tokens and its address bits (LIVE_BITS at most); a full one only lets more through."""
    tokens = saved(tokens.select("token"), "shared")
    width = min(LIVE_BITS, max(18, (32 * tokens.count()).bit_length()))
    spot = tokens.select(F.shiftrightunsigned("token", 64 - width).alias("h"))
    bits = spot.groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("bits"))
    whole = bytearray((1 << width) // 8)
    for r in bits.collect():  # bucket k holds the cells from 32768 (k - 1) on
        at = (r.bucket - 1) * 4096
        whole[at : at + len(r.bits)] = bytes(r.bits)
    return tokens.sparkSession.sparkContext.broadcast(bytes(whole)), width


def _linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = sorted((len(a), len(b)))
    if small * 100 < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (small + large - both) and both > 0


#: Documents beside the pivot that a task keeps for comparison.
KEPT = 7


def _verify_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot and part, the pivot's own rows first; compares each with them, then with the first few others."""
    at, own, others = None, [], []
    for batch in batches:
        u, v = [], []
        for piece in W.pieces(batch, "_text"):
            for p, part, i, s in zip(*(piece.column(c).to_pylist() for c in ("pivot", "part", "rep")), shingle_sets(piece.column("_text"))):
                if (p, part) != at:
                    at, own, others = (p, part), [], []
                if i == p:
                    own.append((i, s))
                    continue
                for j, o in own + others:
                    if _linked(o, s):
                        u.append(i)
                        v.append(j)
                        break
                if len(others) < KEPT:
                    others.append((i, s))
        kind = batch.schema.field("rep").type
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and part, members first, then the documents that probe it; pairs of one group are known."""
    block, members, union = None, [], np.zeros(0, np.uint64)
    stale = True
    for batch in batches:
        u, v = [], []
        for piece in W.pieces(batch, "_text"):
            names = ("blk", "part", "member", "rep", "grp")
            for b, part, member, i, g, s in zip(*(piece.column(c).to_pylist() for c in names), shingle_sets(piece.column("_text"))):
                if (b, part) != block:
                    block, members, stale = (b, part), [], True
                if member:
                    members.append((i, g, s))
                    stale = True
                    continue
                if stale:
                    union = np.unique(np.concatenate([m for *_, m in members])) if members else np.zeros(0, np.uint64)
                    stale = False
                if len(np.intersect1d(union, s, assume_unique=True)) * 100 < PERCENT * len(s):
                    continue
                done = {g}  # one link to a group is enough
                for j, h, m in members:
                    if h not in done and _linked(m, s):
                        done.add(h)
                        u.append(i)
                        v.append(j)
        kind = batch.schema.field("rep").type
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])


#: Address bits of the bitmaps of ids.
ID_BITS = 24


def _marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with _may: whether their ``key`` may be among ids (rep). A bitmap of 2 ** ID_BITS bits whatever the input's
    size; a full one only lets more rows through to the exact join that follows."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS))
    bits = ids.select(spot("rep").alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("_bits"))
    rows = rows.withColumn("_h", spot(key)).withColumn("_at", F.expr("bitmap_bit_position(_h)")).withColumn("_b", F.expr("bitmap_bucket_number(_h)"))
    rows = rows.join(F.broadcast(bits), F.col("_b") == F.col("_bucket"), "left")
    bit = "shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) & 1 = 1"
    return rows.withColumn("_may", F.coalesce(F.expr(bit), F.lit(False))).drop("_h", "_at", "_b", "_bucket", "_bits")


def _with_text(base: DataFrame, rows: DataFrame) -> DataFrame:
    texts = _marked(base, rows, "_id").where("_may").select(F.col("_id").alias("rep"), "_text")
    return rows.join(texts.hint("merge"), "rep")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document. Rows that share an id count as one document with several texts."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    digests = saved(base.mapInArrow(W.lean(_digest), f"id {kind}, n long, d1 long, d2 long, k1 long, k2 long, part int, counts binary"), "sets")
    rows = digests.where("part is null")
    parts = digests.where("part is not null").select("part", "counts").repartition(SLICES, "part").mapInArrow(W.lean(_add_up), "part int, counts binary")
    # bounded: 2 ** SKETCH_BITS counters of 2 bytes
    slices = {r[0]: bytes(r[1]) for r in parts.collect()}
    empty = bytes(2 * (1 << SKETCH_BITS) // SLICES)
    sketch = spark.sparkContext.broadcast(b"".join(slices.get(i, empty) for i in range(SLICES)))

    total = rows.count()
    classes = saved(rows.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.count("*").alias("_c")), "classes")

    # step 2: each representative against one of each of its keys
    key = lambda w, k: F.struct(F.lit(w).alias("w"), F.col(k).alias("k"))
    keyed = classes.select("rep", F.explode(F.array(key(1, "k1"), key(2, "k2"))).alias("x")).select("rep", "x.w", "x.k")
    pivot = F.when(F.col("w") == 1, F.min("rep")).otherwise(F.max("rep"))
    pivots = keyed.groupBy("w", "k").agg(pivot.alias("pivot"), F.count("*").alias("_c")).where("_c > 1").withColumn("met", F.col("_c"))
    pairs = hot_join(keyed, pivots, ["w", "k"], 2 * total).where("rep <> pivot").groupBy("pivot", "rep").agg(F.max("met").alias("met"))
    pairs = saved(pairs.select("pivot", "rep", F.pmod(F.xxhash64("rep"), F.ceil(F.col("met") / MEET)).alias("part")), "pairs")
    ends = pairs.unionByName(pairs.select("pivot", "part").distinct().withColumn("rep", F.col("pivot")))
    work = _with_text(base, ends).repartition(n_parts, "pivot", "part").sortWithinPartitions("pivot", "part", F.expr("rep <> pivot")).select("pivot", "part", "rep", "_text")
    near = components(saved(work.mapInArrow(W.lean(_verify_pivots), f"u {kind}, v {kind}"), "links"))

    # step 3: the tokens that several classes share, blocks, and the matrix
    shared = base.mapInArrow(W.lean(_prefixes(sketch)), "token long, d1 long").groupBy("token").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b")
    entries = saved(base.mapInArrow(W.lean(_entries(sketch, *_live_tokens(shared))), f"token long, id {kind}, n int").where("id is not null"), "entries")
    lasts = entries.where("n = 0").groupBy("id").agg(F.min("token").alias("last")).withColumnRenamed("id", "rep")
    grouped = classes.select("rep").join(near.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").join(lasts.hint("merge"), "rep").select("rep", "last", F.coalesce("component", "rep").alias("grp"))
    grouped = saved(grouped, "groups")
    large = grouped.groupBy("grp").agg(F.count("*").alias("_c")).where(F.col("_c") > BLOCK).withColumn("home", F.concat(F.lit("g"), F.col("grp").cast("string")))
    homes = saved(hot_join(grouped, large, ["grp"], total, "left").withColumn("home", F.coalesce("home", F.concat(F.lit("t"), F.col("last").cast("string")))), "homes")
    room = homes.groupBy("home").agg(F.count("*").alias("_c")).where(F.col("_c") > BLOCK).withColumn("size", F.col("_c"))
    count = F.coalesce(F.least(F.ceil(F.col("size") / BLOCK), F.ceil(F.sqrt("size"))), F.lit(1))
    split = F.pmod(F.xxhash64("rep"), count).cast("string")
    blocks = saved(hot_join(homes, room, ["home"], total, "left").select("rep", "grp", F.concat("home", F.lit("/"), split).alias("blk")), "blocks")
    matrix = entries.where("n > 0").join(blocks.hint("merge"), F.col("id") == F.col("rep"))
    matrix = saved(matrix.groupBy("token", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("grp").alias("g1"), F.max("grp").alias("g2")), "matrix")

    # step 4: which blocks can hold a linked pair. Sets x <= y that share a >= t/(1+t) (x+y) share at least a - ceil(t y) + 1
    # of their prefixes, which is over t/(1+t) (x - t y): least for the least x and the largest y of two blocks.
    one, two = (matrix.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("blk", "low", "high", "g1", "g2")]) for k in "ab")
    met = one.join(two, "token").where(f"blka <= blkb and (g1a <> g2a or g1b <> g2b or g1a <> g1b) and lowa * {PERCENT} <= highb * 100 and lowb * {PERCENT} <= higha * 100")
    met = met.groupBy("blka", "blkb").agg(F.count("*").alias("c"), F.min(F.least("lowa", "lowb")).cast("long").alias("x"), F.max(F.greatest("higha", "highb")).cast("long").alias("top"))
    least = f"greatest(1, {PERCENT} * (100 * x - {PERCENT} * top) div {100 * (100 + PERCENT)} + 1)"
    met = saved(met.where(f"c >= {least}").select("blka", "blkb"), "met")
    asked = saved(met.join(blocks.hint("merge"), F.col("blka") == F.col("blk")).select(F.col("blkb").alias("blk"), "rep", "grp"), "asked")
    many = asked.groupBy("blk").agg(F.count("*").alias("_c")).where(F.col("_c") > MEET).withColumn("met", F.col("_c"))
    parts = F.coalesce(F.ceil(F.col("met") / MEET), F.lit(1))
    asked = saved(hot_join(asked, many, ["blk"], asked.count(), "left").select("blk", "rep", "grp", F.pmod(F.xxhash64("rep"), parts).alias("part"), F.lit(False).alias("member")), "asked")
    inside = asked.select("blk", "part").distinct().join(blocks, "blk").select("blk", "rep", "grp", "part", F.lit(True).alias("member"))
    work = _with_text(base, saved(asked.unionByName(inside), "work")).repartition(n_parts, "blk", "part").sortWithinPartitions("blk", "part", F.desc("member")).select("blk", "part", "member", "rep", "grp", "_text")
    more = saved(work.mapInArrow(W.lean(_open_blocks), f"u {kind}, v {kind}"), "links")

    # step 5
    final = near if more.isEmpty() else components(near.selectExpr("node as u", "component as v").unionAll(more))
    named = classes.select("d1", "d2", "n", "rep", "_c").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", "_c", F.coalesce("component", "rep").alias("component_id"))
    some = hot_join(rows.where("n > 0").select("id", "n", "d1", "d2"), saved(named, "named"), ["d1", "d2", "n"], total, "left").select("id", "n", "component_id")
    none = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the least id of each group stays; documents of no group stay too.

    Of rows that share an id one stays, of the least digest of its text; rows of null id all stay."""
    found = saved(groups(docs, id_col, text_col), "groups").where(F.col(id_col).isNotNull())
    some = found.groupBy(F.col(id_col).alias("rep")).agg(F.count("*").alias("_n"), F.min("component_id").alias("_least"))
    # all that does not simply stay; other rows need no shuffle
    some = saved(some.where("_n > 1 or rep <> _least").withColumn("_stays", F.col("rep") == F.col("_least")).select("rep", "_stays"), "special")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _marked(rows, some, "_id")
    plain = rows.where("_id is null or not _may").select("_row")
    judged = rows.where("_id is not null and _may").join(some.hint("merge"), F.col("_id") == F.col("rep"), "left")
    plain = plain.unionAll(judged.where("rep is null").select("_row"))
    repeated = judged.where("_stays").groupBy("_id").agg(F.min_by("_row", F.xxhash64("_text")).alias("_row")).select("_row")
    return plain.unionAll(repeated).select("_row.*")
