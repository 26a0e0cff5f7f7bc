"""Top lists, samples, frequency tables and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions import values
from pulse.operators.ordered import HOT_ROWS, first_per_group, order_by, with_row_number


def top_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows; give the order a unique last column."""
    return df.orderBy(*order_by(order)).limit(n)


def with_position(df: DataFrame, order: Sequence[str], name: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number all rows from 1 in the given order."""
    return with_row_number(df, [], order, name, hot_rows)


def drop_last(df: DataFrame, position: str) -> DataFrame:
    """Leave out the row with the highest position."""
    return df.where(F.col(position) < df.agg(F.max(position)).scalar())


def threshold_sample(
    df: DataFrame, column: str, threshold: float, order: Sequence[str], above: bool = True, n: int = 15
) -> DataFrame:
    """The first ``n`` rows beyond a bound in the frame's own order, then sorted by the value."""
    beyond = df.where(F.col(column) > threshold if above else F.col(column) < threshold)
    sample = top_n(beyond, order, n)
    return sample.orderBy(*order_by([f"-{column}" if above else column, *order]))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first; nulls are not counted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(*order_by(["-count", column]))


def group_sizes(df: DataFrame, key: str, counted: str) -> DataFrame:
    """Non-null values of ``counted`` per group, largest group first."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(counted).alias("count"))
    return sizes.orderBy(*order_by(["-count", key]))


def keep_large_groups(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Rows of groups with at least ``min_rows`` rows.

    Groups are counted with a pre-aggregated pass, so no group is gathered.
    """
    large = df.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min_rows)
    return df.join(large.select(key), key, "left_semi")


def top_groups_per_bucket(df: DataFrame, bucket: str, group: str, counted: str, n: int = 2) -> DataFrame:
    """The ``n`` most frequent groups in every bucket."""
    counts = df.dropna("any", subset=[bucket, group]).groupBy(bucket, group).agg(F.count(counted).alias("count"))
    best = first_per_group(counts, [bucket], ["-count", group], n)
    return best.orderBy(*order_by([bucket, "-count", group]))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Rows per equal-width bin, with the edges of the bin; empty bins are listed too."""
    known = df.where(F.col(column).isNotNull())
    low, high = known.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin bigint, low double, high double, count bigint")
    width = (high - low) / bins
    counts = known.groupBy(values.bucket(column, low, high, bins).alias("bin")).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule.

    Equal values are counted first; every distinct value then adds to each grid
    point in a pre-aggregated sum, so only the grid leaves the map side.
    """
    known = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    rows, low, high, spread = known.agg(F.count("x"), F.min("x"), F.max("x"), F.stddev_samp("x")).first()
    if not rows or not spread:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = spread * rows ** (-1 / 5)
    step = (high - low) / (points - 1)
    weights = known.groupBy("x").agg(F.count("*").alias("weight"))
    spots = weights.withColumn("spot", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    place = F.lit(low) + F.col("spot") * F.lit(step)
    kernel = F.exp(-F.pow((place - F.col("x")) / F.lit(width), 2.0) / 2) * F.col("weight")
    total = spots.groupBy("spot").agg((F.sum(kernel) / F.lit(rows * width * math.sqrt(2 * math.pi))).alias("density"))
    return total.select(place.alias("x"), "density")


def binned_count_2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Rows per cell of two equal-width binnings."""
    known = df.dropna("any", subset=[x, y])
    ends = known.agg(*[f(F.col(c).cast("double")) for c in (x, y) for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], "x_bin bigint, y_bin bigint, count bigint")
    return known.groupBy(
        values.bucket(x, ends[0], ends[1], bins).alias("x_bin"),
        values.bucket(y, ends[2], ends[3], bins).alias("y_bin"),
    ).agg(F.count("*").alias("count"))
