"""One linear yes/no model per label, all labels fitted in the same passes over the rows.

A round sends the weight matrix (labels x features) to the tasks, which add up losses and gradients of all labels;
the sums are merged label by label on the executors and one row per label comes back. The number of jobs depends on the rounds
only. The steps between two rounds (limited-memory BFGS with step halving) are small matrix work on the driver, whose size is
checked before the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.session import settle

#: Most numbers in the weight matrix, 400 MB with the history of the fit.
LARGEST = 2_500_000
HISTORY, TOLERANCE = 8, 1e-6
#: Rows in a block of features, 6 MB for 2,048 of them.
BLOCK = 256


def _summed(parts: DataFrame, labels: int) -> np.ndarray:
    """Sum of the arrays of each label, merged on the executors; one row per label is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = values.values.to_numpy()
                sums[label] = sums[label] + part if label in sums else part
        yield _rows(list(sums), list(sums.values()))

    merged = parts.repartition("label").mapInArrow(run, "label int, sums array<double>").collect()
    found = {r["label"]: np.array(r["sums"]) for r in merged}
    width = len(next(iter(found.values()))) if found else 0
    return np.array([found.get(i, np.zeros(width)) for i in range(labels)])


def _rows(labels: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(labels, pa.int32()), pa.array(sums, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["label", "sums"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(rows: DataFrame, labels: int) -> DataFrame:
    """Rows in blocks of numbers that are not zero, written once: every pass reads these and no arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, y = _matrix(part.column(0)), _marks(part, labels)
                places = np.flatnonzero(x)
                columns = [pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32())]
                columns += [pa.array([v.tobytes()], pa.binary()) for v in (places.astype("<u4"), x.ravel()[places], y.astype("u1"))]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "width", "places", "numbers", "marks"])

    return settle(rows.mapInArrow(run, "n int, width int, places binary, numbers binary, marks binary"))


def _blocks(batch: pa.RecordBatch, labels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and marks of each block."""
    for n, width, places, numbers, marks in zip(*batch.columns):
        x = np.zeros((n.as_py(), width.as_py()))
        x.ravel()[np.frombuffer(places.as_buffer(), "<u4")] = np.frombuffer(numbers.as_buffer(), "<f8")
        yield x, np.frombuffer(marks.as_buffer(), "u1").reshape(len(x), labels).astype(float)


def _passes(blocks: DataFrame, each, labels: int) -> np.ndarray:
    """``each`` gives one array per label for features and marks of a block; their sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x, y in _blocks(batch, labels):
                part = each(x, y)
                total = part if total is None else total + part
        if total is not None:
            yield _rows(list(range(len(total))), list(total))

    return _summed(blocks.mapInArrow(run, "label int, sums array<double>"), labels)


def _marks(batch: pa.RecordBatch, labels: int) -> np.ndarray:
    """(rows, labels) of zeros and ones from lists of label numbers."""
    lists = batch.column(1)
    out = np.zeros((len(lists), labels))
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


def fit(df: DataFrame, labels: str, names: list[str], vector: str, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of all labels. ``vector`` is an array column, ``labels`` a list of names.

    The loss is the mean logistic loss plus ``penalty`` / 2 times the squared weights of standardised features. A label
    that no row (every row) has is never (always) suggested.
    """
    count = len(names)
    if not count:
        return np.zeros((0, 0)), np.zeros(0)
    listed = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    number = F.transform(listed, lambda x: F.array_position(F.lit(list(names)), x).cast("int") - 1)
    marks = F.array_distinct(F.filter(number, lambda x: x >= 0))
    rows = _packed(df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("vector"), marks.alias("marks")), count)

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        return np.column_stack([y.sum(0), np.tile(seen, (count, 1))])

    first = _passes(rows, moments, count)
    if not first.size or not first[0, 1]:
        return np.zeros((count, 0)), np.full(count, -np.inf)
    positive, n, width = first[:, 0], first[0, 1], (first.shape[1] - 2) // 2
    if count * (width + 1) > LARGEST:
        raise ValueError(f"{count} labels of {width} features are too many for one fit; fit them in groups")
    mean, square = first[0, 2 : 2 + width] / n, first[0, 2 + width :] / n
    spread = np.sqrt(np.maximum(square - mean**2, 0) * n / max(n - 1, 1))
    scale = np.divide(1, spread, out=np.zeros(width), where=spread > 1e-12)
    share = positive / n
    open_ = (share > 0) & (share < 1)
    weights = np.zeros((count, width + 1))
    weights[open_, -1] = np.log(share[open_]) - np.log1p(-share[open_])

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = df.sparkSession.sparkContext.broadcast(w)

        def each(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            w = shared.value
            z = x @ (w[:, :-1] * scale).T + w[:, -1]
            apart = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            loss = (np.logaddexp(0, z) - y * z).sum(0)
            return np.column_stack([loss, apart.T @ x * scale, apart.sum(0)])

        sums = _passes(rows, each, count) / n
        shared.destroy()
        body = np.column_stack([w[:, :-1], np.zeros(count)])
        return sums[:, 0] + penalty / 2 * (body**2).sum(1), sums[:, 1:] + penalty * body

    done = _descend(weights, open_, evaluate, rounds)
    return done[:, :-1] * scale, np.where(open_, done[:, -1], np.where(share > 0, np.inf, -np.inf))


def _descend(w: np.ndarray, open_: np.ndarray, evaluate, rounds: int) -> np.ndarray:
    """Limited-memory BFGS for all rows of ``w`` side by side; a row stops when its loss stands still."""
    running, past = open_.copy(), []
    loss, slope = evaluate(w)
    for number in range(rounds):
        if not running.any():
            break
        way = -_curved(slope, past)
        down = (way * slope).sum(1)
        bad = down >= 0
        way[bad], down[bad] = -slope[bad], -(slope[bad] ** 2).sum(1)
        step = np.ones(len(w)) if number else 1 / np.maximum(np.sqrt((slope**2).sum(1)), 1)
        step[~running] = 0
        for _ in range(20):
            tried = w + step[:, None] * np.where(running[:, None], way, 0)
            new_loss, new_slope = evaluate(tried)
            poor = running & ~(new_loss <= loss + 1e-4 * step * down)
            if not poor.any():
                break
            step[poor] /= 2
        tried[poor], new_loss[poor], new_slope[poor] = w[poor], loss[poor], slope[poor]
        past = [*past, (tried - w, new_slope - slope)][-HISTORY:]
        running &= ~(np.abs(loss - new_loss) <= TOLERANCE * np.maximum(np.abs(new_loss), 1e-12)) & ~poor
        w, loss, slope = tried, new_loss, new_slope
    return w


def _curved(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Slope times the estimated inverse of the second derivatives, label by label."""
    q, kept = slope.copy(), []
    for s, y in reversed(past):
        bend = (s * y).sum(1)
        good = bend > 1e-14
        rho = np.divide(1, bend, out=np.zeros(len(bend)), where=good)
        a = rho * (s * q).sum(1)
        q -= a[:, None] * y
        kept.append((s, y, rho, a))
    if past:
        s, y = past[-1]
        size = (y * y).sum(1)
        factor = np.divide((s * y).sum(1), size, out=np.ones(len(size)), where=(size > 1e-300) & ((s * y).sum(1) > 0))
        q *= factor[:, None]
    for s, y, rho, a in reversed(kept):
        b = rho * (y * q).sum(1)
        q += (a - b)[:, None] * s
    return q
