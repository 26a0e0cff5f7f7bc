"""Bootstrap intervals of group means in one pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights come from polynomials modulo this prime, so products stay below 2^62.
PRIME = 2**31 - 1
#: A weight is the number of these bounds at or below a number drawn evenly from 0 to PRIME - 1: Poisson with mean 1.
BOUNDS = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]

# Groups whose sums a task holds before it hands them on, and rows it weighs at once.
GROUPS = 512
ROWS = 1_000


def seeds(key: Sequence[str]) -> list[Column]:
    """Four numbers per row from the MD5 of its key; columns are joined by ``|``, null counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % PRIME for i in range(4)]


def weights(seed: np.ndarray, replicates: int) -> np.ndarray:
    """Weight of each row (four seeds) in each replicate: any four replicates of a row are independent."""
    number = np.arange(1, replicates + 1, dtype=np.int64)
    drawn = np.broadcast_to(seed[:, 3:4], (len(seed), replicates))
    for i in (2, 1, 0):
        drawn = (drawn * number + seed[:, i : i + 1]) % PRIME
    return np.searchsorted(np.array(BOUNDS), drawn, side="right")


def bootstrap_means(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    key: Sequence[str],
    replicates: int = 1_000,
    level: float = 0.95,
) -> DataFrame:
    """Mean per group with the limits ``low`` and ``high`` of its bootstrap interval.

    Poisson bootstrap: every replicate gives every row a weight of its own, drawn by a
    hash of ``key``, which must tell the rows apart (rows with equal keys share their
    weights). So rows are read once, no row is copied, and a retried task repeats its
    numbers. Tasks sum weights and weighted values of all replicates per group; the
    shuffle moves these sums, whatever the number of rows. The limits are the quantiles
    of the replicate means, interpolated; a replicate that draws no row of a group is
    left out there. Null and NaN values are left out; a group with no other has
    null limits. Null groups are groups.
    """
    if not groups or replicates < 1 or not 0 < level < 1:
        raise ValueError("at least one group column and one replicate, and a level between 0 and 1")
    number = F.col(value).cast("double")
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.select(
        *[F.col(c).alias(n) for c, n in zip(groups, names)],
        F.when(~F.isnan(number), number).alias("v"),
        F.array(*seeds(key)).alias("seed"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    plain = rows.groupBy(*names).agg(F.avg("v").alias("mean"), F.count("v").alias("count"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def hand_on() -> pd.DataFrame:
            parts = [(*g, w.tolist(), s.tolist()) for g, (w, s) in held.items()]
            held.clear()
            return pd.DataFrame(parts, columns=[*names, "w", "s"])

        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.iloc[start : start + ROWS]
                drawn = weights(np.array(part["seed"].tolist(), dtype=np.int64), replicates).astype(np.float64)
                numbers = part["v"].to_numpy(dtype=np.float64)
                for group, places in part.groupby(names, dropna=False, sort=False).indices.items():
                    group = tuple(None if pd.isna(g) else g for g in (group if isinstance(group, tuple) else (group,)))
                    sums = held.setdefault(group, [np.zeros(replicates), np.zeros(replicates)])
                    sums[0] += drawn[places].sum(axis=0)
                    sums[1] += numbers[places] @ drawn[places]
                if len(held) >= GROUPS:
                    yield hand_on()
        if held:
            yield hand_on()

    # Groups travel as text, so that whole numbers with nulls keep their type in pandas.
    texts = [F.col(n).cast("string").alias(n) for n in names]
    schema = ", ".join([*[f"{n} string" for n in names], "w array<double>", "s array<double>"])
    parts = rows.where("v IS NOT NULL").select(*texts, "v", "seed").mapInPandas(add, schema)
    each = parts.select(*names, F.posexplode(F.arrays_zip("w", "s")).alias("replicate", "sums"))
    sums = each.groupBy(*names, "replicate").agg(F.sum("sums.w").alias("w"), F.sum("sums.s").alias("s"))
    ends = [(1 - level) / 2, (1 + level) / 2]
    limits = sums.groupBy(*names).agg(F.percentile(F.try_divide("s", "w"), F.array(*[F.lit(e) for e in ends])).alias("ends"))
    limits = limits.select(*[F.col(n).cast(kinds[n]).alias(f"_{n}") for n in names], "ends")
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    joined = plain.join(limits, same, "left")
    return joined.select(
        *[F.col(n).alias(c) for c, n in zip(groups, names)],
        F.col("mean").alias(f"mean_{value}"),
        "count",
        F.element_at("ends", 1).alias("low"),
        F.element_at("ends", 2).alias("high"),
    )
