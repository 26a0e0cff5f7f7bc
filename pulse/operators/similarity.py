"""Order articles by how alike their vectors are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions import values
from pulse.operators.ordered import HOT_ROWS, first_per_group, order_by, with_row_number
from pulse.session import settle

# Rows of one group a task may hold as a matrix: 50,000 x 384 doubles are 154 MB.
CHAIN_ROWS = 50_000


def with_similarity(df: DataFrame, seed: DataFrame, vector: str = "vector", output: str = "similarity") -> DataFrame:
    """Cosine similarity of every row to the one vector of ``seed``.

    The seed is a single row, so it becomes a constant of the plan.
    """
    row = seed.select(vector).first()
    if row is None:
        raise ValueError("the seed is empty")
    reference = np.asarray(row[0], dtype="float64")
    length = float(np.linalg.norm(reference))
    unit = F.lit((reference / length if length else reference).tolist())
    return df.withColumn(output, F.coalesce(F.try_divide(values.dot(vector, unit), values.norm(vector)), F.lit(0.0)))


def top_article(df: DataFrame, key: str, interactions: str = "facebook_interactions") -> DataFrame:
    """The most engaging article: the default seed."""
    return df.orderBy(*order_by([f"-{interactions}", key])).limit(1)


def similarity_to_seed(
    df: DataFrame, seed: DataFrame, key: str, vector: str = "vector", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All rows ranked from 0 by similarity to a seed vector."""
    scored = with_similarity(df, seed, vector)
    ranked = with_row_number(scored, [], ["-similarity", key], "similarity_rank", hot_rows)
    return ranked.withColumn("similarity_rank", F.col("similarity_rank") - 1)


def similarity_chain(
    df: DataFrame,
    group: str,
    key: str,
    interactions: str = "facebook_interactions",
    vector: str = "vector",
    chain_rows: int = CHAIN_ROWS,
) -> DataFrame:
    """Rank rows of each group so that neighbours are alike.

    Starting from the most engaging row, each step ranks the unranked row most
    similar to the reference vector and moves the reference to the second most
    similar one. A step depends on the one before. Groups of at most
    ``chain_rows`` rows are ranked inside one task each; larger groups are ranked
    by one small Spark job per step, slow but exact, so no group is gathered.
    """
    rows = df.select(group, key, interactions, vector)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_rows"))
    large = settle(sizes.where(F.col("_rows") > chain_rows))
    schema = T.StructType([rows.schema[group], rows.schema[key], T.StructField("similarity_rank", T.LongType())])

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([interactions, key], ascending=[False, True], ignore_index=True)
        ranks = _chain(np.stack(part[vector].to_numpy()).astype("float64"))
        return pd.DataFrame({group: part[group], key: part[key], "similarity_rank": ranks})

    if large.isEmpty():
        return rows.groupBy(group).applyInPandas(rank, schema)
    small = rows.join(large.select(group), group, "left_anti").select(*rows.columns)
    ranked = small.groupBy(group).applyInPandas(rank, schema)
    heavy = rows.join(large.select(group), group, "left_semi").select(*rows.columns)
    steps = large.agg(F.max("_rows")).first()[0]
    return ranked.unionByName(_chain_by_steps(heavy, group, key, interactions, vector, steps))


def _chain(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    units = vectors / np.where(lengths == 0, 1.0, lengths)
    ranks = np.zeros(len(units), dtype="int64")
    open_rows = np.ones(len(units), dtype=bool)
    reference = units[0]
    for step in range(len(units)):
        alike = np.where(open_rows, units @ reference, -np.inf)
        best = int(np.argmax(alike))
        ranks[best] = step
        open_rows[best] = False
        score, alike[best] = alike[best], -np.inf
        if open_rows.any():
            second = int(np.argmax(alike))
            # Equal scores keep the reference on the row just ranked.
            reference = units[best] if alike[second] == score else units[second]
    return ranks


def _chain_by_steps(df: DataFrame, group: str, key: str, interactions: str, vector: str, steps: int) -> DataFrame:
    length = values.norm(vector)
    unit = F.transform(F.col(vector), lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))
    rows = settle(df.select(group, key, interactions, unit.alias("_unit")))
    best = first_per_group(rows, [group], [f"-{interactions}", key])
    reference = settle(best.select(group, F.col("_unit").alias("_reference")))
    placed = None
    for step in range(steps):
        left = rows if placed is None else rows.join(placed.select(group, key), [group, key], "left_anti")
        near = left.join(reference, group).withColumn("_alike", values.dot("_unit", "_reference"))
        order = ["-_alike", f"-{interactions}", key]
        pair = settle(with_row_number(first_per_group(near, [group], order, 2), [group], order, "_place"))
        taken = pair.where("_place = 1").select(group, key, F.lit(step).cast("long").alias("similarity_rank"))
        placed = taken if placed is None else placed.unionByName(taken)
        if step % 50 == 49:
            placed = settle(placed)
        first = pair.where("_place = 1").select(group, F.col("_alike").alias("_top"), F.col("_unit").alias("_first"))
        second = pair.where("_place = 2").select(group, F.col("_alike").alias("_next"), F.col("_unit").alias("_second"))
        moved = F.when(F.col("_next") < F.col("_top"), F.col("_second")).otherwise(F.col("_first"))
        # One row per large group: a small table.
        reference = settle(first.join(second, group, "left").select(group, moved.alias("_reference")))
    return placed
