"""Near-duplicate groups by BagMinHash signatures of word-shingle multisets.

Every text is a multiset of five-word shingles (a text of fewer words is one shingle). The weight of a
shingle is cut at the levels 1, 2, 4, 8, ...; each level interval carries a Poisson process of points
whose rate is the interval's length, every point falls on one signature slot, and points of the last,
partly used interval count only when their own level is within the weight. A slot keeps its smallest
point, so two slots agree with the probability of the weighted Jaccard similarity. Processes are followed
only until no point can lower a slot. Signatures are cut into bands; texts that share a band are compared
on their multisets.

Inside a band bucket every text is compared with the bucket's first text, which joins groups of copies in
one step. Texts of buckets that still hold several groups go through an exact join: their shingles are
ordered by rarity, two similar texts must share one of the rarest fifth, and all pairs of different groups
that do are compared. So no link between texts that share a band is lost.

Texts with the same words are one class from the start, so copies never form pairs. Null texts and texts
without words are alone. Other columns are not read; ids must be unique and not null (a row without an id
keeps its row, with the class of its copies or none). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import settle

WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, SLOTS, ROWS, SIMILAR = 5, 128, 4, 0.8
#: Texts and shingles that one signature step of a task holds, and words whose hash a worker remembers.
STEP_TEXTS, STEP_SHINGLES, REMEMBERED = 1_024, 500_000, 500_000
#: Rounds of joining classes; a job that needs more raises instead of returning unfinished groups.
ROUNDS = 60


class _Hashes(dict):
    """Hashes of words, kept for the next text."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles, sorted, and their counts."""
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(out, return_counts=True)


def shingles(text: str | None) -> Counter:
    """Hashes of the word shingles with their counts."""
    keys, counts = _bag(WORDS.findall(text or ""))
    return Counter(dict(zip(keys.tolist(), counts.tolist())))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step, on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """The smallest point on every slot, over all processes of each multiset; one row per multiset."""
    keys = np.concatenate([k for k, _ in bags])
    weights = np.concatenate([w for _, w in bags]).astype(np.int64)
    levels = np.ceil(np.log2(weights)).astype(np.int64)  # intervals (0,1], (1,2], (2,4], ...
    copies = levels + 1
    owner = np.repeat(np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags]), copies)
    seeds = np.repeat(keys, copies)
    level = np.arange(len(seeds)) - np.repeat(np.cumsum(copies) - copies, copies)
    weight = np.repeat(weights, copies)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    seeds = _mix(seeds ^ _mix(level.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    best, at, turn = np.full((len(bags), slots), np.inf), np.zeros(len(seeds)), 0
    while len(seeds):
        turn += 1
        draw = _mix(seeds + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        live = at < best.max(axis=1)[owner]
        if not live.all():
            seeds, at, rate, low, weight, draw, owner = (x[live] for x in (seeds, at, rate, low, weight, draw, owner))
        other = _mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
        within = low + rate * ((other >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53 <= weight
        slot = owner * slots + (_mix(other) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(best.reshape(-1), slot[within], at[within])
    return best


def signature(bag: Counter, slots: int = SLOTS) -> np.ndarray:
    """The signature of one multiset."""
    return _signatures([(np.fromiter(bag.keys(), np.uint64, len(bag)), np.fromiter(bag.values(), np.int64, len(bag)))], slots)[0]


def _bands(bags: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    """One hash per band of every multiset."""
    rows = _signatures(bags).reshape(len(bags), -1, ROWS) if bags else []
    return [[xxhash.xxh64_intdigest(r.tobytes(), i) - 2**63 for i, r in enumerate(one)] for one in rows]


def signatures(docs: DataFrame) -> DataFrame:
    """``id``, ``key`` (digest of the words), ``weight`` (number of shingles) and ``bands`` of rows (id, text).

    Texts without words have no bands, and a key of their own.
    """
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(ids: list, keys: list, bags: list) -> pa.RecordBatch:
            full = iter(_bands([b for b in bags if len(b[0])]))
            values = [
                pa.array(ids, first), pa.array(keys, pa.binary()), pa.array([int(b[1].sum()) for b in bags], pa.int64()),
                pa.array([next(full) if len(b[0]) else None for b in bags], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(values, names=["id", "key", "weight", "bands"])

        for batch in batches:
            first, ids, keys, bags, held = batch.schema.field(0).type, [], [], [], 0
            for name, text in zip(batch.column(0), batch.column(1)):
                words = WORDS.findall(text.as_py() or "")
                ids.append(name.as_py())
                keys.append(hashlib.sha256((" ".join(words) if words else f"\n{ids[-1]}").encode()).digest())
                bags.append(_bag(words))
                held += len(bags[-1][0])
                if len(ids) == STEP_TEXTS or held >= STEP_SHINGLES:
                    yield step(ids, keys, bags)
                    ids, keys, bags, held = [], [], [], 0
            if ids:
                yield step(ids, keys, bags)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, key binary, weight long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Keep pairs (a, b) whose multisets are similar enough."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            good = [similarity(shingles(x), shingles(y)) >= SIMILAR for x, y in zip(ta, tb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["a", "b", "good"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, good boolean")


def _components(links: DataFrame) -> DataFrame:
    """``id`` and ``root``, the smallest id of its component, of all linked ids, by min-label rounds with pointer jumps."""
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id"))
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        hooked = labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = settle(hooked.join(jump, "root", "left").select("id", "old", F.coalesce("up", "root").alias("root")))
        moved = new.where("old <> root").isEmpty()
        labels = new.select("id", "root")
        if moved:
            return labels
    raise RuntimeError("near-duplicate groups did not settle")


def _grams(texts: DataFrame) -> DataFrame:
    """One row per shingle of rows (id, root, weight, text): ``gram`` and its count ``n``."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3)):
                keys, counts = _bag(WORDS.findall(text.as_py() or ""))
                same = pa.array([i] * len(keys), pa.int64())
                columns = [batch.column(c).take(same) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["id", "root", "weight", "gram", "n"])

    return texts.select("id", "root", "weight", "text").mapInArrow(run, f"id {kinds['id']}, root {kinds['root']}, weight long, gram long, n long")


def _rare_pairs(texts: DataFrame) -> DataFrame:
    """All pairs (a, b) of different roots that can be similar, for rows (id, root, weight, text).

    In one order of all shingles, rarest first, two similar texts share a shingle of the first
    ``weight - ceil(SIMILAR * weight) + 1``. At the first one they share, neither may have passed so many
    others that what follows is less than the overlap they need; a long passage that many texts quote thus
    gives no pairs of texts whose own words differ.
    """
    grams = settle(_grams(texts))
    spread = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    before = Window.partitionBy("id").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    enough = F.col("weight") - F.ceil(F.col("weight") * SIMILAR - 1e-6) + 1
    keys = settle(ranked.where((F.col("before") < enough) & (F.col("df") > 1)).select("gram", "id", "root", "weight", (F.col("weight") - F.col("before")).alias("rest")))
    open_keys = keys.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    x = keys.join(open_keys.select("gram"), "gram")
    y = keys.select("gram", F.col("id").alias("other"), F.col("root").alias("root2"), F.col("weight").alias("weight2"), F.col("rest").alias("rest2"))
    need = (F.col("weight") + F.col("weight2")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    met = x.join(y, "gram").where((F.col("root") < F.col("root2")) & (F.least("rest", "rest2") >= need))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _sizes_fit(x: str, y: str) -> Column:
    """Two multisets of very unlike sizes are never similar."""
    return F.least(x, y) >= F.greatest(x, y) * SIMILAR - 1e-6


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repeated: bool = False) -> DataFrame:
    """One row per document: id and ``class_id``, the smallest id of its group of near copies.

    ``repeated`` allows rows that repeat id and text.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    seen = settle(signatures(rows))
    exact = settle(seen.groupBy("key").agg(F.min("id").alias("rep")))
    own = seen.where("bands is not null").join(exact.select(F.col("rep").alias("id")), "id", "left_semi")
    own = own.dropDuplicates(["id"]) if repeated else own
    banded = own.select("id", "weight", F.posexplode("bands").alias("band", "hash"))
    # The first text of a bucket is a minimum, summed before the shuffle; hot buckets stay small.
    first = banded.groupBy("band", "hash").agg(F.min(F.struct("id", "weight")).alias("f"), F.count("*").alias("n")).where("n > 1")
    shared = settle(banded.join(first, ["band", "hash"]).select("band", "hash", "id", "weight", F.col("f.id").alias("a"), F.col("f.weight").alias("size")))
    met = rows.join(shared.select("id").distinct(), "id", "left_semi")
    texts = settle(met.dropDuplicates(["id"]) if repeated else met)
    star = settle(shared.where("id <> a").where(_sizes_fit("weight", "size")).select("a", F.col("id").alias("b")).distinct())
    found = settle(_verify(star, texts).where("good").select("a", "b"))
    # Texts of buckets that the first round left in different groups.
    grouped = shared.join(_components(found), "id", "left").select("band", "hash", "id", "weight", F.coalesce("root", "id").alias("root"))
    mixed = grouped.groupBy("band", "hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    left = grouped.join(mixed.select("band", "hash"), ["band", "hash"]).select("id", "root", "weight").distinct()
    pairs = _rare_pairs(texts.join(left, "id")).join(star, ["a", "b"], "left_anti")
    again = _verify(settle(pairs), texts).where("good").select("a", "b")
    roots = _components(settle(found.union(again))).select(F.col("id").alias("rep"), "root")
    ends = exact.join(roots, "rep", "left").select("key", F.coalesce("root", "rep").alias("class_id"))
    return seen.select(F.col("id").alias("doc_id"), "key").join(ends, "key").select("doc_id", "class_id")
