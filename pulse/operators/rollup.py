"""Daily rollups of interactions that answer any range of days without the raw rows.

A cell is a day, a dimension and one of its members (a theme, an index, an item of a list; the dimension ``""`` stands
for all rows) with the number of rows, of known counts and their sum. Distinct values, such as the
subindexes of a theme on a day, are bitmaps over dense ids, which merge by OR over days, members and batches, so
counts of distinct values stay exact for every range. Batches are added to a stored rollup; only the buckets
of their days are rewritten, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions import dates
from pulse.operators.ranking import with_position
from pulse.operators.snapshots import with_change
from pulse.sources.store import Store

_text, _long = T.StringType(), T.LongType()
CELLS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in zip(
            ("day", "dimension", "member", "counted", "part", "n", "known", "total", "bits"),
            (T.DateType(), _text, _text, _text, _long, _long, _long, _long, T.BinaryType()),
        )
    ]
)
IDS = T.StructType([T.StructField("counted", _text), T.StructField("value", _text), T.StructField("id", _long)])
_KEYS = ["day", "dimension", "member", "counted", "part"]


def _named(name: str, key: str, value: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(name).alias(key), x.cast("string").alias(value))


def _members(df: DataFrame, dimensions: Mapping[str, str]) -> Column:
    """Dimension and member of every cell a row belongs to; null members have none."""
    kinds = dict(df.dtypes)
    lists = [F.array(F.struct(F.lit("").alias("dimension"), F.lit(None).cast("string").alias("member")))]
    for name, column in dimensions.items():
        items = F.col(column) if kinds[column].startswith("array") else F.array(column)
        items = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())
        lists.append(F.transform(items, _named(name, "dimension", "member")))
    return F.concat(*lists)


def cells(df: DataFrame, day: str, dimensions: Mapping[str, str], counted: Mapping[str, Sequence[str]], ids: DataFrame) -> DataFrame:
    """Cells of a batch of rows. ``counted`` has the columns whose distinct values count, per dimension."""
    rows = df.withColumn("_day", F.to_date(day))
    wide = rows.select("*", F.inline(_members(df, dimensions)))
    sums = wide.groupBy(F.col("_day").alias("day"), "dimension", "member").agg(
        F.count("*").alias("n"), F.count("facebook_interactions").alias("known"), F.sum("facebook_interactions").alias("total")
    )
    sums = sums.select("day", "dimension", "member", F.lit(None).cast("string").alias("counted"), F.lit(0).cast("long").alias("part"),
                       "n", "known", "total", F.lit(None).cast("binary").alias("bits"))
    pairs = values_of(wide, counted).distinct().join(ids, ["counted", "value"])
    bits = pairs.groupBy("day", "dimension", "member", "counted", F.bitmap_bucket_number("id").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )
    none = F.lit(None).cast("long")
    return sums.unionByName(bits.select("*", none.alias("n"), none.alias("known"), none.alias("total")))


def values_of(wide: DataFrame, counted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values to count, with their cell, from rows that already have dimension and member."""
    kinds = dict(wide.dtypes)
    lists = []
    for dimension, columns in counted.items():
        for column in columns:
            items = F.col(column) if kinds[column].startswith("array") else F.array(column)
            items = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())
            pairs = F.transform(items, _named(column, "counted", "value"))
            lists.append(F.when(F.col("dimension") == dimension, pairs).otherwise(F.array().cast("array<struct<counted:string,value:string>>")))
    return wide.select(F.col("_day").alias("day"), "dimension", "member", F.inline(F.concat(*lists)))


def merge(rows: DataFrame) -> DataFrame:
    """Cells of several batches as one."""
    bits = F.when(F.col("counted").isNotNull(), F.col("bits"))
    merged = rows.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total"), F.bitmap_or_agg(bits).alias("_bits"))
    return merged.select(*CELLS.names[:-1], F.when(F.col("counted").isNotNull(), F.col("_bits")).alias("bits"))


def add(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    batch: str,
    day: str,
    dimensions: Mapping[str, str],
    counted: Mapping[str, Sequence[str]],
    buckets: int = 16,
) -> Store:
    """Add a named batch of rows to the rollup below ``path``; a batch that is there already changes nothing."""
    table = Store(spark, f"{path}/cells", CELLS, "day", buckets)
    if not table.files().where(F.col("file") == batch).isEmpty():
        return table
    wide = df.withColumn("_day", F.to_date(day)).select("*", F.inline(_members(df, dimensions)))
    ids = _numbered(Store(spark, f"{path}/ids", IDS, "value", buckets), values_of(wide, counted).select("counted", "value").distinct())
    fresh = cells(df, day, dimensions, counted, ids.read())
    changed = table.touched(fresh)
    rows = merge(table.read(changed).unionByName(fresh))
    loaded = spark.createDataFrame([(batch, None, None)], "file string, modified timestamp, length long")
    return table.commit(rows, changed, loaded)


def _numbered(ids: Store, values: DataFrame) -> Store:
    """Give new values the numbers after the highest one in use."""
    fresh = values.join(ids.read(), ["counted", "value"], "left_anti")
    if fresh.isEmpty():
        return ids
    top = ids.read().agg(F.max("id")).first()[0]
    numbered = with_position(fresh, ["counted", "value"], "id").withColumn("id", F.col("id") + F.lit(-1 if top is None else int(top)))
    changed = ids.touched(fresh)
    return ids.commit(ids.read(changed).unionByName(numbered.select(*IDS.names)), changed)


def between(table: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Cells of a range of days; without bounds also those of rows without a day."""
    kept = table if first is None else table.where(F.col("day") >= F.lit(first).cast("date"))
    return kept if last is None else kept.where(F.col("day") <= F.lit(last).cast("date"))


def distinct_counts(table: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distinct values of a counted column per ``keys`` (of day, dimension and member)."""
    parts = table.where(F.col("counted") == column).groupBy(*keys, "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(f"n_{column}"))


def kpis(table: DataFrame, distinct: Mapping[str, str]) -> DataFrame:
    """Row count, sum and mean of interactions, and distinct values: one row, as from the raw rows."""
    whole = table.where(F.col("dimension") == "")
    sums = whole.where(F.col("counted").isNull())
    totals = sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_articles"),
        F.sum("total").alias("sum_interactions"),
        F.round(F.try_divide(F.sum("total"), F.sum("known")), 2).alias("mean_interactions"),
    )
    for name, column in distinct.items():
        merged = whole.where(F.col("counted") == column).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
        totals = totals.withColumn(name, merged.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).scalar())
    return totals.select(*distinct, "n_articles", "sum_interactions", "mean_interactions")


def _sums(table: DataFrame, dimension: str) -> DataFrame:
    return table.where((F.col("dimension") == dimension) & F.col("counted").isNull())


def label_stats(table: DataFrame, dimension: str, counted: str) -> DataFrame:
    """Mean, count and number of distinct values per member and day."""
    sums = _sums(table, dimension).where(F.col("day").isNotNull())
    mean = F.try_divide(F.sum("total"), F.sum("known")).alias("facebook_interactions")
    stats = sums.groupBy("member", "day").agg(mean, F.sum("known").alias("count"))
    unlike = distinct_counts(table.where(F.col("dimension") == dimension), ["member", "day"], counted)
    joined = stats.join(unlike, ["member", "day"], "left")
    return joined.select(F.col("member").alias(dimension), "day", "facebook_interactions", "count", F.coalesce(f"n_{counted}", F.lit(0)).alias(f"n_{counted}"))


def series(table: DataFrame, dimension: str, how: str) -> DataFrame:
    """Count, mean or sum of interactions per month-day and member."""
    measure = {"count": F.sum("n"), "sum": F.sum("total"), "mean": F.try_divide(F.sum("total"), F.sum("known"))}[how]
    rows = _sums(table, dimension).withColumn("month_day", dates.month_day("day"))
    return rows.groupBy("month_day", F.col("member").alias(dimension)).agg(measure.alias(f"{how}_interactions"))


def change(table: DataFrame, dimension: str, how: str = "mean") -> DataFrame:
    """Daily aggregate per member with percent and absolute change since the member's previous day."""
    measure = {"sum": F.sum("total"), "mean": F.try_divide(F.sum("total"), F.sum("known"))}[how]
    column = "facebook_interactions"
    totals = _sums(table, dimension).where(F.col("day").isNotNull()).groupBy(F.col("member").alias(dimension), F.col("day").alias("date_extracted")).agg(measure.alias(column))
    return with_change(totals, dimension, column)
