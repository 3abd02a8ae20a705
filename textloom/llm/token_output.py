"""Token-id output: shards of raw ids, each with a minimal perfect hash index.

Texts are encoded where they are read; only ids travel. They are range-partitioned by (key, place of reading)
and written in ascending key order as a table of shards: raw little-endian ids (16 bits where the vocabulary
allows it) and an index. The index maps a key to a slot by hash-and-displace: a bucket's stored seed sends
all its keys to free slots, so m keys fill exactly m slots; each slot holds the payload's offset and length
and a fingerprint of its key, and a key that is not in the shard is refused by the fingerprint (a miss in
2**32). Keys are not part of the index; ``doc_ids`` lists a shard's documents in order for readers that want
all of them. A keyed read finds the shard by its range, reads that one row and goes straight to the offset.

Keys are (id, occurrence in its shard), so repeated ids keep all rows (in any order among equal ids) and no
id fills one task; null ids come first; null text is empty. Every document ends with the end id. An empty
table gives an empty result; extra columns are ignored. Tables are written by Spark's committed writer into
the shared folder, so lost executors leave no partial shard; the vocabulary is sent to executors as bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import fresh_path, saved

#: A shard ends at so many documents or ids.
SHARD_DOCS = 1 << 16
SHARD_IDS = 4 << 20
CACHE_UNITS = 1_000_000
#: Bytes of text that are encoded at once.
PIECE = 1 << 20
#: Unicode white space beyond ASCII; texts with it, or with a special token, are encoded whole.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


_GAPS = frozenset(b" \t\n\x0b\x0c\r")
_LETTER, _MARK = np.zeros(256, np.bool_), np.zeros(256, np.bool_)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


class Encoder:
    """Whole texts to ids. White-space-led units encode alike wherever they stand (no pre-token
    crosses the gap before white space), so each distinct unit is encoded once and kept in a
    bounded cache, found by hash and compared byte by byte; texts for which any of that does not hold,
    and texts with units of over W.LONG bytes, are encoded whole."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: bytes of each id: the vocabulary writes a byte as one character
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self._reset()

    def _reset(self) -> None:
        """Known units: sorted hashes with the slots of their ids, kept in arrays for their size."""
        self.known, self.slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 20, self.dtype), 0, 0
        self.starts, self.sizes = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        #: bytes of each known unit, eight spare ones behind them
        self.bytes, self.filled, self.spelled = np.zeros(1 << 20, np.uint8), 0, np.zeros(0, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted keys, -1 for new ones."""
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == keys, self.slot_of[at], -1) if len(self.known) else np.full(len(keys), -1)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used += len(ids)
        self.n += len(sizes)

    def _learn(self, keys: np.ndarray, units: list[bytes], wide: bool) -> None:
        """Encodes new units: those led by white space joined, 128 at a time, the others alone.

        The bytes of each id tell which unit it belongs to."""
        led = [i for i, u in enumerate(units) if u[0] in _GAPS and u[-1] not in _GAPS and not (wide and _WIDE.search(u))]
        alone = sorted(set(range(len(units))) - set(led))
        first = self.n
        for a in range(0, len(led), 128):
            part = [units[i] for i in led[a : a + 128]]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.int64)
            bounds = np.cumsum([len(u) for u in part])
            owner = np.searchsorted(bounds, np.cumsum(self.lengths[ids]) - self.lengths[ids], "right")
            self._add(ids.astype(self.dtype), np.bincount(owner, minlength=len(part)))
        for i in alone:
            ids = self._whole(units[i])
            self._add(ids, np.array([len(ids)]))
        spelling = np.frombuffer(b"".join([units[i] for i in led + alone]), np.uint8)
        while self.filled + len(spelling) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.filled : self.filled + len(spelling)] = spelling
        sizes = np.array([len(units[i]) for i in led + alone], np.int64)
        self.spelled = np.concatenate([self.spelled, self.filled + np.cumsum(sizes) - sizes])
        self.filled += len(spelling)
        new, slots = keys[led + alone], np.arange(first, self.n, dtype=np.int32)
        order = np.argsort(new)
        at = np.searchsorted(self.known, new[order])
        self.known, self.slot_of = np.insert(self.known, at, new[order]), np.insert(self.slot_of, at, slots[order])

    def _differ(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Units (ranges of data) that are spelled otherwise than their slots' units."""
        given, known = W.eights(data), np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, strides=(1,))
        size, own = end - begin, self.spelled[slot]
        ends = np.append(self.spelled, self.filled)
        bad = size != ends[slot + 1] - own
        live, at = np.flatnonzero(~bad), 0
        while len(live):
            mask = W.MASKS[np.minimum(size[live] - at, 8)]
            bad[live] |= ((given[begin[live] + at] ^ known[own[live] + at]) & mask) != 0
            at += 8
            live = live[(size[live] > at) & ~bad[live]]
        return bad

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        ws = W.tokenize(texts)
        n = len(texts)
        raw = ws.data.tobytes()
        off = np.zeros(n + 1, np.int64)
        np.cumsum([0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()], out=off[1:])
        odd = {d for m in _WIDE.finditer(raw) for d in [int(np.searchsorted(off, m.start(), "right")) - 1]}
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd.add(int(np.searchsorted(off, at, "right")) - 1)
                at = raw.find(s, at + 1)
        # a unit: the gap before a word and the word; what follows the last word is a unit too.
        # Inside a word, an ASCII mark behind an ASCII letter begins another unit: a pre-token ends there.
        tails = np.flatnonzero(off[1:] > np.where(ws.counts > 0, ws.end[np.maximum(ws.first[1:] - 1, 0)] if len(ws.end) else 0, off[:-1]))
        begin = np.concatenate([off[:1], ws.end[:-1]]) if len(ws.end) else np.zeros(0, np.int64)
        heads = ws.first[:-1][ws.counts > 0]
        begin[heads] = off[:-1][ws.counts > 0]
        tail_begin = np.where(ws.counts[tails] > 0, ws.end[np.maximum(ws.first[1:][tails] - 1, 0)] if len(ws.end) else 0, off[:-1][tails])
        begin, end = np.concatenate([begin, tail_begin]), np.concatenate([ws.end, off[1:][tails]])
        owner = np.concatenate([np.repeat(np.arange(n), ws.counts), tails])
        order = np.argsort(begin, kind="stable")
        begin, end, owner = begin[order], end[order], owner[order]
        cut = np.flatnonzero(_LETTER[ws.data[:-1]] & _MARK[ws.data[1:]]) + 1
        at = np.searchsorted(begin, cut, "right") - 1
        inner = cut > begin[at] if len(cut) else np.zeros(0, np.bool_)
        cut, at = cut[inner], at[inner]
        begin, owner = np.insert(begin, at + 1, cut), np.insert(owner, at + 1, owner[at])
        end = np.append(begin[1:], off[-1])
        keys = W.byte_hashes(ws.data, begin, end)
        long = end - begin > W.LONG  # encoded with their whole texts; here they stand for nothing
        odd |= set(owner[long].tolist())
        begin, end, owner, keys = begin[~long], end[~long], owner[~long], keys[~long]
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_UNITS:
            self._reset()
        slots = self._slots(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            spots = at[new]
            self._learn(distinct[new], [raw[a:b] for a, b in zip(begin[spots].tolist(), end[spots].tolist())], bool(odd))
            slots = self._slots(distinct)
        slot = slots[back] if len(back) else np.zeros(0, np.int64)
        odd |= set(owner[self._differ(ws.data, begin, end, slot)].tolist())
        sizes = self.sizes[slot].astype(np.int64)
        upto = np.cumsum(sizes)
        flat = self.pool[np.repeat(self.starts[slot] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate([[0], upto])[np.searchsorted(owner, np.arange(n + 1))]
        out = [flat[bounds[d] : bounds[d + 1]] for d in range(n)]
        for d in odd:
            out[d] = self._whole(raw[off[d] : off[d + 1]])
        return out


def key_hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes a key."""
    return np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys), "<u8").reshape(-1, 2).copy()


def _spread(h: np.ndarray, seed: np.ndarray, m: int) -> np.ndarray:
    return (W.mix(h ^ W.mix((seed + 1).astype(np.uint64))) % np.uint64(m)).astype(np.int64)


def build_index(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket (negative: -1 - slot, for buckets of one key) and the slot of each key."""
    m = len(keys)
    h = key_hashes(keys)
    r = max(1, -(-m // 4))
    bucket = (h[:, 0] % np.uint64(r)).astype(np.int64)
    seeds, slot, free = np.zeros(r, np.int32), np.full(m, -1, np.int64), np.ones(m, np.bool_)
    members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=r))[:-1])
    for b in sorted(range(r), key=lambda x: -len(members[x])):
        own = members[b]
        if len(own) < 2:
            break
        seed, step = 0, 16
        while True:  # many seeds at once
            to = _spread(h[own, 1][None, :], np.arange(seed, seed + step)[:, None], m)
            ordered = np.sort(to, axis=1)
            fits = np.flatnonzero(free[to].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(fits):
                seed, to = seed + int(fits[0]), to[fits[0]]
                break
            seed, step = seed + step, min(1024, step * 4)
        seeds[b], slot[own], free[to] = seed, to, False
    spare = iter(np.flatnonzero(free).tolist())
    for b in range(r):
        if len(members[b]) == 1:
            s = next(spare)
            seeds[b], slot[members[b][0]] = -1 - s, s
    return seeds, slot


def find_slots(seeds: np.ndarray, m: int, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and fingerprint of each key in a block of m keys."""
    h = key_hashes(keys)
    seed = seeds[(h[:, 0] % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    spread = _spread(h[:, 1], np.maximum(seed, 0), m)
    return np.where(seed < 0, -1 - seed, spread), (h[:, 0] >> np.uint64(32)).astype("<u4")


SHARD = "shard long, first_id {kind}, last_id {kind}, n_docs int, n_ids long, width int, doc_ids array<{kind}>, seeds binary, fingerprints binary, offsets binary, lengths binary, payload binary"


def _keys(ids: list) -> list[str]:
    """Of the documents of a shard, in order: id and occurrence."""
    out, last, seen = [], object(), 0
    for i in ids:
        seen = seen + 1 if i == last else 0
        last = i
        out.append(f"{'null' if i is None else i!s}{'~' if i is None else '#'}{seen}")
    return out


def _shard(number: int, ids: list, parts: list[bytes], width: int) -> dict:
    keys = _keys(ids)
    seeds, slot = build_index(keys)
    sizes = np.array([len(p) // width for p in parts], np.int64)
    offsets, lengths, prints = np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<u4")
    offsets[slot], lengths[slot] = np.cumsum(sizes) - sizes, sizes
    prints[slot] = (key_hashes(keys)[:, 0] >> np.uint64(32)).astype("<u4")
    return {"shard": number, "first_id": ids[0], "last_id": ids[-1], "n_docs": len(ids), "n_ids": int(sizes.sum()), "width": width, "doc_ids": ids, "seeds": seeds.astype("<i4").tobytes(),
            "fingerprints": prints.tobytes(), "offsets": offsets.tobytes(), "lengths": lengths.tobytes(), "payload": b"".join(parts)}


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Writes the shards of all documents below ``path``. ``vocabulary``: a tokenizer file that the driver can read."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = _encoder(sent.value), TaskContext.get().partitionId() << 36
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for piece in W.pieces(batch, "_text", limit=PIECE):
                ids = [part.tobytes() + end for part in encoder.encode(piece.column("_text"))]
                seq = np.arange(at, at + len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(seq, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), encoder.dtype.itemsize), pa.int32())], names=["_id", "_seq", "_ids", "_width"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, held, width = TaskContext.get().partitionId() << 24, [], [], 0, 2
        schema = None
        for batch in batches:
            id_type = batch.schema.field("_id").type
            schema = pa.schema([("shard", pa.int64()), ("first_id", id_type), ("last_id", id_type), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(id_type)), ("seeds", pa.binary()), ("fingerprints", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])
            for key, raw, width in zip(batch.column("_id").to_pylist(), batch.column("_ids"), batch.column("_width").to_pylist()):
                ids.append(key)
                parts.append(raw.as_py())
                held += len(parts[-1]) // width
                if len(ids) >= SHARD_DOCS or held >= SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([_shard(number, ids, parts, width)], schema=schema)
                    number, ids, parts, held = number + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(number, ids, parts, width)], schema=schema)

    encoded = saved(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(W.lean(encode), f"_id {kind}, _seq long, _ids binary, _width int"), "encoded")
    ordered = encoded.repartitionByRange(n, "_id", "_seq").sortWithinPartitions("_id", "_seq")
    ordered.mapInArrow(W.lean(pack), SHARD.format(kind=kind)).write.option("compression", "zstd").parquet(path)


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    key = hashlib.sha256(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _payload(row: dict, keys: list[str]) -> Iterator[np.ndarray | None]:
    """Ids of each key by the shard's index; None for a key that is not there."""
    seeds, m = np.frombuffer(row["seeds"], "<i4"), row["n_docs"]
    ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
    prints, offsets, lengths = np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["lengths"], "<i8")
    for s, f in zip(*(x.tolist() for x in find_slots(seeds, m, keys))):
        yield ids[offsets[s] : offsets[s] + lengths[s]] if prints[s] == f else None


def read_back(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each fetched by its key.

    One row per shard is collected to place the shards."""
    shards = spark.read.parquet(path)
    kind = shards.schema["first_id"].dataType.simpleString()
    starts, at = {}, 0
    for shard, n in sorted(tuple(r) for r in shards.select("shard", "n_ids").collect()):
        starts[shard], at = at, at + n
    sent = spark.sparkContext.broadcast(starts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, out = sent.value[row["shard"]], []
                for key, ids in zip(row["doc_ids"], _payload(row, _keys(row["doc_ids"]))):
                    out.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                k, s, n, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, batch.schema.field("doc_ids").type.value_type), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    read = shards.select("shard", "n_docs", "width", "doc_ids", "seeds", "fingerprints", "offsets", "lengths", "payload")
    return read.mapInArrow(W.lean(digest), f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


class Reader:
    """Keyed access: the shards' ranges are read once (one row a shard); each look-up then opens one shard's row a key."""

    def __init__(self, spark: SparkSession, path: str):
        self.shards = spark.read.parquet(path).drop("doc_ids")
        rows = self.shards.select("first_id", "last_id", "shard").where("last_id is not null").collect()
        rows.sort(key=lambda r: r.shard)
        self.last, self.numbers = [r.last_id for r in rows], [r.shard for r in rows]

    def get(self, keys: list) -> dict:
        """Ids of the first document of each key that is there."""
        where: dict[int, list] = {}
        for k in keys:
            i = bisect.bisect_left(self.last, k)
            if i < len(self.last):
                where.setdefault(self.numbers[i], []).append(k)
        found: dict = {}
        for row in self.shards.where(F.col("shard").isin(list(where))).toLocalIterator() if where else ():
            row = row.asDict()
            for k, ids in zip(where[row["shard"]], _payload(row, [f"{k}#0" for k in where[row["shard"]]])):
                if ids is not None:
                    found[k] = ids.tolist()
        return found


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the documents and returns what the files say of each."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write(docs, path, vocabulary, id_col, text_col)
    return read_back(spark, path, id_col)
