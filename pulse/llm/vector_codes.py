"""Product-quantisation codes by a dual-tree Lloyd iteration in exact integers.

Vectors are cut into 16 equal consecutive parts, each part position has a codebook of 64 entries. A task
grows one tree over the parts of its batch of rows and one over the entries, for all positions at once,
and walks both trees together: a pair of nodes whose least distance exceeds another pair's greatest one is
pruned; a node of parts left with a single entry is assigned whole, with the sums it has cached; only
leaves left with several entries compare every part with them. All distances are integers, so every
assignment is the brute-force one, ties included.

A round sends back one row per entry and batch, summed by Spark; the codebooks (16 x 64 entries, whatever
the number of vectors) are all the driver holds.

Rows whose vector is null or holds a null or non-finite component are left out. The width is that of the
longest vector kept, rounded up to a multiple of 16; shorter vectors are read as if zeros followed. Integers
are held within +-2^24 (components of magnitude 65,536), so that squared distances fit. Rows that repeat an
id are coded each; rows without an id come last among the first entries. An empty table gives no rows.
Columns besides id, vector and label are not read; results replace none, as only results are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 2**24
#: Rows for which one tree is grown, parts in a leaf, and pairs compared at once.
BATCH, LEAF, PAIRS = 4_096, 16, 8_192


class Tree:
    """Balanced trees over rows, one per part position, with boxes, sums and counts of every node.

    ``values`` is (positions, rows, width). Rows beyond the last are repeated with weight 0, so that all
    leaves have the same size and every level is one array.
    """

    def __init__(self, values: np.ndarray, leaf: int, weight: np.ndarray):
        p, n, d = values.shape
        self.depth = max(0, (-(-n // leaf) - 1).bit_length())
        size = leaf << self.depth
        order = np.broadcast_to(np.minimum(np.arange(size), n - 1), (p, size)).copy()
        real = np.arange(size) < n
        slot = np.broadcast_to(np.arange(size), (p, size)).copy()
        for level in range(self.depth):
            nodes, m = 1 << level, size >> level
            held = np.take_along_axis(values, order[..., None], 1).reshape(p, nodes, m, d)
            wide = (held.max(2) - held.min(2)).argmax(-1)
            key = np.take_along_axis(held, wide[..., None, None], 3)[..., 0]
            half = np.argpartition(key, m // 2, axis=-1) if m > 1 else np.zeros_like(key, dtype=int)
            order = np.take_along_axis(order.reshape(p, nodes, m), half, 2).reshape(p, size)
            slot = np.take_along_axis(slot.reshape(p, nodes, m), half, 2).reshape(p, size)
        self.order, self.leaf = order, leaf
        self.weight = np.take_along_axis(weight, order, 1) * real[slot]
        held = np.take_along_axis(values, order[..., None], 1)
        self.held = held.reshape(p, size // leaf, leaf, d)
        low, high = self.held.min(2), self.held.max(2)
        sums = (held * self.weight[..., None]).reshape(p, size // leaf, leaf, d).sum(2)
        counts = self.weight.reshape(p, size // leaf, leaf).sum(2)
        self.levels = [(low, high, sums, counts)]
        for _ in range(self.depth):
            low, high = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])
            sums, counts = sums[:, ::2] + sums[:, 1::2], counts[:, ::2] + counts[:, 1::2]
            self.levels.append((low, high, sums, counts))
        self.levels.reverse()


def entry_tree(books: np.ndarray) -> Tree:
    """A tree with one entry a leaf; of equal entries only the first counts, as ties go to it."""
    weight = np.zeros(books.shape[:2], np.int64)
    for p, book in enumerate(books):
        weight[p, np.unique(book, axis=0, return_index=True)[1]] = 1
    return Tree(books, 1, weight)


def assign(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Nearest entry of every part, and sums and counts per entry.

    ``values`` is (positions, rows, width) and ``books`` (positions, entries, width), both integers.
    """
    p, n, d = values.shape
    rows, entries = Tree(values, LEAF, np.ones((p, n), np.int64)), entry_tree(books)
    codes = np.zeros((p, rows.order.shape[1]), np.int64)
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    seen = {"pairs": 0, "whole": 0, "compared": 0}
    # Pairs of nodes: position, node of parts, node of entries; pairs of one node of parts are neighbours.
    at, a, b, la, lb = np.arange(p), np.zeros(p, np.int64), np.zeros(p, np.int64), 0, 0
    while True:
        seen["pairs"] += len(at)
        low, high, node_sums, node_counts = (x[at, a] for x in rows.levels[la])
        elow, ehigh, _, alive = (x[at, b] for x in entries.levels[lb])
        gap = np.maximum(0, np.maximum(elow - high, low - ehigh))
        far = np.maximum(ehigh - low, high - elow)
        least, most = (gap * gap).sum(1), (far * far).sum(1)
        most[alive == 0] = np.iinfo(np.int64).max
        node = at * (1 << la) + a
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(node)]))
        keep = (least <= bound) & (alive > 0)
        at, a, b, node, node_sums, node_counts = (x[keep] for x in (at, a, b, node, node_sums, node_counts))
        if lb == entries.depth:
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            single = np.repeat(np.diff(np.r_[starts, len(node)]) == 1, np.diff(np.r_[starts, len(node)]))
            if single.any():
                q, s, e = at[single], a[single], entries.order[at[single], b[single]]
                np.add.at(sums, (q, e), node_sums[single])
                np.add.at(counts, (q, e), node_counts[single])
                width = codes.shape[1] >> la
                codes[q[:, None], s[:, None] * width + np.arange(width)] = e[:, None]
                seen["whole"] += len(q)
            at, a, b = (x[~single] for x in (at, a, b))
        if not len(at) or (la == rows.depth and lb == entries.depth):
            break
        # Children of both sides; a side that has reached its leaves stays, pairs stay grouped by node of parts.
        if lb < entries.depth:
            at, a, b = np.repeat(at, 2), np.repeat(a, 2), np.repeat(b * 2, 2) + np.tile([0, 1], len(b))
            lb += 1
        if la < rows.depth:
            at, a, b = np.repeat(at, 2), np.repeat(a * 2, 2) + np.tile([0, 1], len(a)), np.repeat(b, 2)
            by = np.argsort(at * (1 << (la + 1)) + a, kind="stable")
            at, a, b = at[by], a[by], b[by]
            la += 1
    while len(at):
        # Uncertain leaves, some whole nodes at a time: every part against every entry left.
        end = len(at)
        if end > PAIRS:
            node = at * (1 << la) + a
            end = PAIRS + int(np.searchsorted(node[PAIRS:], node[PAIRS - 1], "right"))
        q, s, e = at[:end], a[:end], entries.order[at[:end], b[:end]]
        at, a, b = at[end:], a[end:], b[end:]
        apart = rows.held[q, s] - books[q, e][:, None, :]
        apart = (apart * apart).sum(2)
        node = q * (1 << la) + s
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        spread = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
        best = np.minimum.reduceat(apart, starts)
        chosen = np.minimum.reduceat(np.where(apart == best[spread], e[:, None], books.shape[1]), starts)
        q, s = q[starts], s[starts]
        places = s[:, None] * LEAF + np.arange(LEAF)
        codes[q[:, None], places] = chosen
        weight = rows.weight[q[:, None], places]
        np.add.at(sums, (q[:, None], chosen), rows.held[q, s] * weight[..., None])
        np.add.at(counts, (q[:, None], chosen), weight)
        seen["compared"] += apart.size
    out = np.zeros((p, n), np.int64)
    np.put_along_axis(out, rows.order, codes, 1)
    return out, sums, counts, seen


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """(positions, rows, width of a part) of a list column, shorter lists followed by zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return np.ascontiguousarray(out.reshape(len(sizes), PARTS, width // PARTS).transpose(1, 0, 2))


def batches_of(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    """Entries from the vectors with the smallest ids; of equal ids the smaller vector comes first."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    return integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)


def moved(books: np.ndarray, rows: DataFrame, width: int) -> np.ndarray:
    """Codebooks after one round over all rows."""
    d = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches_of(batches):
            _, s, c, _ = assign(integers(batch.column(0), width), books)
            sums, counts = sums + s, counts + c
        p, e = np.nonzero(counts)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e])]
        columns.append(pa.array(list(sums[p, e]), pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["p", "e", "n", "s"])

    partial = rows.select("vector").mapInArrow(run, "p int, e int, n long, s array<long>")
    totals = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d)))
    out = books.copy()
    for r in totals.collect():  # at most one row per entry, whatever the number of vectors
        out[r.p, r.e] = [r[f"s{i}"] // r.n for i in range(d)]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Code, error and codebook digest of every usable vector."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-(longest or 0) // PARTS)) * PARTS
    books = first_books(rows, width) if longest is not None else np.zeros((PARTS, 0, width // PARTS), np.int64)
    for _ in range(ROUNDS if books.shape[1] else 0):
        books = moved(books, rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            values = integers(batch.column(2), width)
            codes = assign(values, books)[0]
            apart = values - np.take_along_axis(books, codes[..., None], 1)
            errors = (apart * apart).sum((0, 2))
            texts = [x.tobytes().hex() for x in codes.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts), pa.array(errors)], names=["vec_id", "label", "code", "error"]
            )

    coded = rows.mapInArrow(run, f"vec_id {kinds[vec_id]}, label {kinds[label]}, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over rows of the same label."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")
