"""Ordered work inside a group that stays distributed when one group is huge.

A plain window puts every row of a group into one task. That is fine up to a
bounded number of rows, so each function first counts rows per group (a
pre-aggregated pass over the key columns). Groups below ``hot_rows`` use the
plain window. Rows of larger groups are range-partitioned by the full sort key,
so one group spans many tasks; each task works on its slice, and a small table
with one row per (group, slice) carries state from one slice to the next.

Order is given as column names; a leading ``-`` means descending. Nulls sort
last in both directions. The last column should break ties.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import settle

# Rows one task may order: below 1 GB for rows of a few hundred bytes. Sorting
# spills, so wider rows still work; callers can pass a smaller number.
HOT_ROWS = 1_000_000

# Most rows of a helper table (hot keys, slice ends) that every task may hold.
HELPER_ROWS = 500_000


def order_by(order: Sequence[str]) -> list[Column]:
    """Sort columns for names with an optional leading minus."""
    return [
        F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()
        for name in order
    ]


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group.

    The rank filter is pushed below the shuffle as a group limit, so a map task
    sends at most ``n`` rows of a group and a hot group stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by(order))
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a frame for broadcast after checking that it has at most ``rows`` rows.

    A larger frame comes back as it is, for a shuffle join.
    """
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number rows 1, 2, … inside each group, or over all rows without keys."""

    def plain(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order_by(order))
        return part.withColumn(name, F.row_number().over(window).cast("long"))

    def sliced(part: DataFrame, attach: Callable) -> DataFrame:
        spans = part.groupBy(*keys, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        joined = attach(part, spans)
        return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_offset") + 1).drop(
            "_first", "_rows", "_offset"
        )

    return _by_size(df, keys, order, plain, sliced, hot_rows)


def with_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add each column's value on the previous row of the group; ``columns`` maps new name to source."""

    def plain(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order_by(order))
        return part.withColumns({new: F.lag(old).over(window) for new, old in columns.items()})

    def sliced(part: DataFrame, attach: Callable) -> DataFrame:
        last = F.max_by(F.struct(*[F.col(old).alias(new) for new, old in columns.items()]), "_at")
        tails = part.groupBy(*keys, "_slice").agg(last.alias("_tail"))
        tails = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice"))).drop(
            "_tail"
        )
        inside = Window.partitionBy(*keys, "_slice").orderBy("_at")
        seen = part.withColumn("_previous", F.lag(F.struct(*[F.col(o).alias(n) for n, o in columns.items()])).over(inside))
        joined = attach(seen, tails)
        return joined.withColumns(
            {new: F.coalesce("_previous", "_carry").getField(new) for new in columns}
        ).drop("_previous", "_carry")

    return _by_size(df, keys, order, plain, sliced, hot_rows)


def with_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Replace nulls by the last value seen before them in the group."""

    def plain(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order_by(order)).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})

    def sliced(part: DataFrame, attach: Callable) -> DataFrame:
        ends = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_end_{c}") for c in columns]
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        tails = part.groupBy(*keys, "_slice").agg(*ends)
        tails = tails.withColumns({f"_end_{c}": F.last(f"_end_{c}", ignorenulls=True).over(earlier) for c in columns})
        inside = Window.partitionBy(*keys, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        filled = part.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
        joined = attach(filled, tails)
        return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_end_{c}")) for c in columns}).drop(
            *[f"_end_{c}" for c in columns]
        )

    return _by_size(df, keys, order, plain, sliced, hot_rows)


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    name: str,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Sum of ``column`` from the start of the group up to and including each row.

    Without keys, a caller that knows the number of rows can pass it to save a count.
    """

    def plain(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order_by(order)).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumn(name, F.sum(column).over(window))

    def sliced(part: DataFrame, attach: Callable) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        tails = part.groupBy(*keys, "_slice").agg(F.sum(column).alias("_sum"))
        tails = tails.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
        inside = Window.partitionBy(*keys, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        joined = attach(part.withColumn(name, F.sum(column).over(inside)), tails)
        return joined.withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")

    return _by_size(df, keys, order, plain, sliced, hot_rows, rows)


def paged_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    page_rows: int = 1_000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ordered lists per group, cut into pages of at most ``page_rows`` items.

    No row is dropped: a group with more items has more pages. A group that fits
    in one page has exactly the list a plain aggregate would give.
    """
    numbered = with_row_number(df, keys, order, "_item", hot_rows)
    numbered = numbered.withColumn("page", F.expr(f"(_item - 1) div {page_rows}") + 1)
    item = F.struct("_item", *[F.col(old).alias(new) for new, old in columns.items()])
    lists = numbered.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return lists.withColumns({new: F.col(f"_items.{new}") for new in columns}).drop("_items")


def _by_size(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame, Callable[[DataFrame, DataFrame], DataFrame]], DataFrame],
    hot_rows: int,
    rows: int | None = None,
) -> DataFrame:
    if not keys:
        rows = df.count() if rows is None else rows
        return plain(df) if rows <= hot_rows else _slice(df, keys, order, rows, 1, sliced, hot_rows)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
    if hot.isEmpty():
        return plain(df)
    hot = settle(hot)
    rows, groups = hot.agg(F.sum("_rows"), F.count("*")).first()
    hot = F.broadcast(hot) if groups <= HELPER_ROWS else hot
    heavy = _slice(_match(df, hot, keys, "left_semi"), keys, order, rows, groups, sliced, hot_rows)
    return plain(_match(df, hot, keys, "left_anti")).unionByName(heavy)


def _slice(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    groups: int,
    sliced: Callable[[DataFrame, Callable[[DataFrame, DataFrame], DataFrame]], DataFrame],
    hot_rows: int,
) -> DataFrame:
    slices = max(2, math.ceil(4 * rows / hot_rows))
    sort = [*[F.col(k).asc_nulls_last() for k in keys], *order_by(order)]
    # Range bounds come from a sample taken when the shuffle runs. Writing the
    # result once fixes the slices for all later branches and for lost executors.
    placed = settle(
        df.repartitionByRange(slices, *sort)
        .sortWithinPartitions(*sort)
        .withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    # Groups lie next to each other, so there are at most this many (group, slice) pairs.
    small = slices + groups <= HELPER_ROWS

    def attach(part: DataFrame, ends: DataFrame) -> DataFrame:
        return _match(part, F.broadcast(ends) if small else ends, [*keys, "_slice"])

    return sliced(placed, attach).drop("_slice", "_at")


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null."""
    if not keys:
        return left
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_key_{k}" for k in keys])
