"""Token-id shards with a minimal perfect hash index for keyed access.

Shards hold raw little-endian unsigned 32-bit ids of documents in ascending id order and are bounded by bytes.
Every shard has an index built by displacement: keys are dealt to small buckets, and per bucket the smallest seed is
stored that sends its keys to free slots, so that n keys fill exactly n slots. A slot holds the key's
fingerprint and the place of its ids; a lookup is one bucket, one slot, one comparison and one read. A shard also
states its first and last key, so a reader opens only the shards that can hold a key.

Null and empty texts hold the end id only. Ids of documents may have any type that sorts; rows without one come
last. Rows that repeat an id are all stored, in order of a hash of their texts; a key is an id with the number of
its occurrence in the shard, and a read by id gives every occurrence. An empty table writes no shards. A read takes
one absent id in four billion for a present one, as fingerprints have 32 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm import byte_bpe
from pulse.session import scratch_path, settle

END, BUCKET = 2, 4
#: A shard is closed when its ids take this many bytes; a longer document has a shard of its own.
SHARD_BYTES = 1 << 20
SLOT = np.dtype([("print", "<u4"), ("start", "<u8"), ("count", "<u4")])
Key = tuple[object, int]


def _name(key: Key) -> bytes:
    value, number = key
    return f"{number} {type(value).__name__} {value}".encode()


def _hash(name: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(name, seed)


def numbered(values: list) -> list[Key]:
    """Every value, in sorted order, with the number of its occurrence."""
    out: list[Key] = []
    for value in values:
        last, number = out[-1] if out else (object(), 0)
        same = last == value or (last != last and value != value)  # two not-a-numbers
        out.append((value, number + 1 if same else 0))
    return out


def build(keys: list[Key]) -> tuple[np.ndarray, list[int]]:
    """Seeds per bucket, and the slot of every key; keys must differ."""
    if len(set(keys)) < len(keys):
        raise ValueError("keys repeat")
    n, m = len(keys), max(1, -(-len(keys) // BUCKET))
    names, buckets = [_name(key) for key in keys], [[] for _ in range(m)]
    for at, name in enumerate(names):
        buckets[_hash(name, 0) % m].append(at)
    seeds, slots, taken = np.zeros(m, "<u4"), [0] * n, bytearray(n)
    for b in sorted(range(m), key=lambda b: -len(buckets[b])):
        held, seed, places = [names[at] for at in buckets[b]], 0, []
        while len(places) < len(held):
            seed, places = seed + 1, []
            for name in held:
                place = _hash(name, seed) % n
                if taken[place] or place in places:  # no need to place the others
                    break
                places.append(place)
        for at, place in zip(buckets[b], places):
            slots[at], taken[place] = place, 1
        seeds[b] = seed
    return seeds, slots


def lookup(key: Key, seeds: np.ndarray, slots: np.ndarray) -> tuple[int, int] | None:
    """Start and count of the key's ids in its shard, or None."""
    if not len(slots):
        return None
    name = _name(key)
    slot = slots[_hash(name, int(seeds[_hash(name, 0) % len(seeds)])) % len(slots)]
    return (int(slot["start"]), int(slot["count"])) if slot["print"] == _hash(name, 1 << 40) & 0xFFFFFFFF else None


def _file(kind: str) -> str:
    return f"part int, number int, first {kind}, last {kind}, total long, keys array<{kind}>, seeds binary, slots binary, ids binary"


def write(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write shards below ``folder`` and return them, one row each.

    A shard is one row of a Parquet file (index and raw ids), so that Spark's writer commits it whole and a
    lost task leaves nothing behind. Texts are encoded and packed in one pass over the sorted documents.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = columns.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kind, name = columns.schema["doc_id"].dataType.simpleString(), path or byte_bpe.default_path()
    end = byte_bpe.packed([END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part = byte_bpe.codec(name).encode_all, TaskContext.get().partitionId()
        values, payload, size, number = [], [], 0, 0

        def shard(kinds: pa.DataType):
            keys = numbered(values)
            seeds, places = build(keys)
            slots, start = np.zeros(len(keys), SLOT), 0
            for key, place, raw in zip(keys, places, payload):
                slots[place] = (_hash(_name(key), 1 << 40) & 0xFFFFFFFF, start, len(raw) // 4)
                start += len(raw) // 4
            row = {"part": [part], "number": [number], "first": values[:1], "last": values[-1:], "total": [start], "keys": [values]}
            row |= {"seeds": [seeds.tobytes()], "slots": [slots.tobytes()], "ids": [b"".join(payload)]}
            types = [pa.int32(), pa.int32(), kinds, kinds, pa.int64(), pa.list_(kinds), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

        kinds = None
        for batch in batches:
            kinds = batch.column(0).type
            for value, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1))):
                raw = ids + end
                if values and size + len(raw) > SHARD_BYTES:
                    yield shard(kinds)
                    values, payload, size, number = [], [], 0, number + 1
                values.append(value), payload.append(raw)
                size += len(raw)
        if values:
            yield shard(kinds)

    dealt.mapInArrow(run, _file(kind)).write.parquet(folder)
    return spark.read.schema(_file(kind)).parquet(folder)


def _rows(shards: DataFrame, wanted: list | None) -> DataFrame:
    """Documents of the shards, each found through its shard's index; only those of ``wanted`` ids if given."""
    kind = shards.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, keys, seeds, slots, ids = (batch.column(c)[i] for c in range(6))
                seeds, slots = np.frombuffer(seeds.as_buffer(), "<u4"), np.frombuffer(slots.as_buffer(), SLOT)
                raw, kinds = memoryview(ids.as_buffer()), batch.column(2).type.value_type
                if wanted is None:
                    asked = numbered(keys.as_py())
                else:
                    asked = [(w, k) for w in wanted for k in range(_occurrences(w, seeds, slots))]
                found = [lookup(k, seeds, slots) for k in asked]
                sums = [zlib.crc32(raw[4 * s : 4 * (s + c)]) for s, c in found]
                n = len(asked)
                columns = [pa.array([v for v, _ in asked], kinds), pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32())]
                columns += [pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)]
                columns.append(pa.array(sums, pa.int64()))
                if wanted is not None:
                    columns.append(pa.array([bytes(raw[4 * s : 4 * (s + c)]) for s, c in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])

    schema = f"doc_id {kind}, part int, number int, local long, n_tokens long, ids_crc32 long"
    schema += ", ids binary" if wanted is not None else ""
    return shards.select("part", "number", "keys", "seeds", "slots", "ids").mapInArrow(run, schema)


NAMES = ["doc_id", "part", "number", "local", "n_tokens", "ids_crc32", "ids"]


def _occurrences(value: object, seeds: np.ndarray, slots: np.ndarray) -> int:
    """Rows of an id in a shard, by asking for one occurrence after the other."""
    k = 0
    while lookup((value, k), seeds, slots) is not None:
        k += 1
    return k


def starts(shards: DataFrame) -> DataFrame:
    """Ids before every shard: one row per shard, a few thousandths of the documents."""
    sizes = settle(shards.select("part", "number", "total"))
    # Parts follow the order of the ids, shards of a part as well.
    parts = sizes.groupBy("part").agg(F.sum("total").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.select("part", "number", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("_inside"))
    return rows.join(parts, "part").select("part", "number", (F.col("_part") + F.col("_inside")).alias("base"))


def read(shards: DataFrame) -> DataFrame:
    """One row per document of the shards: id, start over all shards, number and checksum of its ids."""
    return _rows(shards, None).join(starts(shards), ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def fetch(shards: DataFrame, keys: list) -> DataFrame:
    """Ids of the documents with the given ids, a list the caller bounds; absent ones have no row.

    Only shards whose first and last key enclose one of them are read (the bounds are statistics of the Parquet
    files, so payloads of other shards stay unread), each through its index. Rows without an id are asked for by None.
    """
    kind = shards.schema["first"].dataType
    asked = [F.lit(k).cast(kind) for k in keys if k is not None]
    held = F.col("last").isNull() if None in keys else F.lit(False)
    for k in asked:
        # Rows without an id come last, so a shard may end with them.
        held = held | ((F.col("first") <= k) & ((F.col("last") >= k) | F.col("last").isNull()))
    return _rows(shards.where(held), list(dict.fromkeys(keys))).select("doc_id", "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all documents below the shared folder and read them back through the index."""
    return read(write(docs, scratch_path(docs.sparkSession, "token-ids"), text, doc_id))
