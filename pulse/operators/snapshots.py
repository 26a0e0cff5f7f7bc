"""Articles seen on several days: changes over time and the data behind each chart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions import dates, text, values
from pulse.operators.ordered import HOT_ROWS, first_per_group, order_by, with_lag

# Sort order of the snapshots of one article; callers may add a tie-break column.
ARTICLE_ORDER = ["-headline", "published", "date_extracted"]

_AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def aggregate(name: str, column: str) -> Column:
    """Aggregate by the name the charts use."""
    return _AGGREGATES[name](column)


def parse_labels(df: DataFrame) -> DataFrame:
    """Theme and index from the first suggested label."""
    first = text.first_literal_item("suggested_labels")
    return df.withColumns({"theme": text.label_part(first, 0), "index": text.label_part(first, 1)})


def article_changes(
    df: DataFrame, ties: Sequence[str] = (), infinite: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Change and relative change of interactions since the previous snapshot of the article."""
    lagged = with_lag(
        df, ["link"], [*ARTICLE_ORDER, *ties], {"_before": "facebook_interactions"}, hot_rows
    )
    # Rows without a link are no series: they have no previous snapshot.
    lagged = lagged.withColumn("_before", F.when(F.col("link").isNotNull(), F.col("_before")))
    return lagged.withColumns(
        {
            "facebook_interactions_abs_change": values.change("facebook_interactions", "_before"),
            "facebook_interactions_pct_change": values.relative_change("facebook_interactions", "_before", infinite),
        }
    ).drop("_before")


def filter_snapshots(
    df: DataFrame,
    min_interactions: int = 500,
    between: tuple[dt.date, dt.date] | None = None,
    excluded_themes: Sequence[str] = (),
    excluded_indexes: Sequence[str] = (),
) -> DataFrame:
    """Snapshots by engagement, day and topic. Rows without a theme or index stay."""
    kept = df.where(F.col("facebook_interactions") >= min_interactions)
    if between:
        kept = kept.where(F.col("date").between(F.lit(between[0]), F.lit(between[1])))
    for column, names in (("theme", excluded_themes), ("index", excluded_indexes)):
        if names:
            kept = kept.where(F.coalesce(~F.col(column).isin(*names), F.lit(True)))
    return kept


def only(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the chosen values."""
    return df.where(F.col(column).isin(*names))


def to_period(df: DataFrame, unit: str, column: str = "date_extracted") -> DataFrame:
    """Replace the extraction date by the first day of its week or month."""
    return df.withColumn(column, dates.period_start(column, unit))


def _axis(by: str) -> Column:
    """``month_day`` folds years together as the charts do; ``date`` keeps them apart."""
    return dates.month_day("date_extracted") if by == "month_day" else F.to_date("date_extracted")


def heatmap(df: DataFrame, dimension: str, by: str = "month_day") -> DataFrame:
    """Mean interactions per day and theme, index, or ``theme_index`` pair."""
    if dimension == "theme_index":
        df = df.withColumn("theme_index", F.concat("theme", F.lit(" > "), "index"))
    return timeseries(df, dimension, "mean", by)


def timeseries(df: DataFrame, dimension: str, how: str, by: str = "month_day") -> DataFrame:
    """Count, mean or sum of interactions per day and theme or index."""
    day = "month_day" if by == "month_day" else "day"
    measure = F.count("*") if how == "count" else aggregate(how, "facebook_interactions")
    known = df.where(F.col(dimension).isNotNull())
    return known.groupBy(_axis(by).alias(day), dimension).agg(measure.alias(f"{how}_interactions"))


def label_counts_by_day(long: DataFrame, column: str) -> DataFrame:
    """Number of articles per month-day and label, from one row per article and label."""
    known = long.where(F.col(column).isNotNull())
    return known.groupBy(dates.month_day("published").alias("month_day"), column).agg(F.count(column).alias("count"))


def calendar(df: DataFrame, column: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Mean interactions per extraction date, optionally for chosen themes or indexes."""
    kept = only(df, column, names) if column else df
    return kept.where(F.col("date_extracted").isNotNull()).groupBy("date_extracted").agg(F.avg("facebook_interactions").alias("facebook_interactions"))


def calendar_bounds(df: DataFrame) -> DataFrame:
    """Lowest and highest daily mean: one row."""
    return calendar(df).agg(
        F.min("facebook_interactions").alias("min_y"), F.max("facebook_interactions").alias("max_y")
    )


def calendar_cells(df: DataFrame, column: str = "date_extracted") -> DataFrame:
    """Daily mean with the week, weekday and month that place it in a calendar chart."""
    return calendar(df.withColumn("date_extracted", F.to_date(column))).withColumns(
        {
            "week": dates.week_of_year("date_extracted"),
            "weekday": dates.weekday_name("date_extracted"),
            "month": F.month("date_extracted"),
        }
    )


def aggregate_change(
    df: DataFrame, key: str, how: str = "mean", column: str = "facebook_interactions", infinite: bool = False
) -> DataFrame:
    """Aggregate per key and date, with percent and absolute change since the key's previous date."""
    known = df.where(F.col(key).isNotNull() & F.col("date_extracted").isNotNull())
    return with_change(known.groupBy(key, "date_extracted").agg(aggregate(how, column).alias(column)), key, column, infinite)


def with_change(totals: DataFrame, key: str, column: str = "facebook_interactions", infinite: bool = False) -> DataFrame:
    """Percent and absolute change of daily totals since the key's previous date."""
    # One row per date is left in a group, so a plain window is bounded by the calendar.
    before = F.lag(column).over(Window.partitionBy(key).orderBy("date_extracted"))
    return totals.withColumn("_before", before).select(
        key,
        "date_extracted",
        column,
        (values.relative_change(column, "_before", infinite) * 100).alias("pct_change"),
        values.change(column, "_before").alias("abs_change"),
    )


def group_rank(df: DataFrame, keys: Sequence[str], how: str, column: str = "facebook_interactions") -> DataFrame:
    """Grouped mean or sum, largest first."""
    known = df.dropna("any", subset=list(keys))
    totals = known.groupBy(*keys).agg(aggregate(how, column).alias(column))
    return totals.orderBy(*order_by([f"-{column}", *keys]))


def slider_bound(ranked: DataFrame, column: str = "facebook_interactions") -> DataFrame:
    """Upper end of a threshold slider: the whole part of the largest value."""
    return ranked.agg(F.max(column).cast("long").alias("max_value"))


def themes_by_total(df: DataFrame) -> DataFrame:
    """Themes with the most interactions first."""
    return group_rank(df, ["theme"], "sum")


def articles_over_threshold(
    df: DataFrame, totals: DataFrame, key: str, criterion: str, threshold: float, ties: Sequence[str] = ("link",)
) -> DataFrame:
    """Articles whose topic and whose date both occur in an aggregate at or above a threshold.

    Topic and date are two separate memberships, so a hot topic also brings its
    articles of another topic's hot day.
    """
    hot = totals.where(F.col(criterion) >= threshold)
    # No broadcast hint: the optimizer broadcasts these lists only when they are small.
    kept = df.join(hot.select(key).distinct(), key, "left_semi")
    kept = kept.join(hot.select("date_extracted").distinct(), "date_extracted", "left_semi")
    columns = ["published", "headline", key, "facebook_interactions", "link"]
    # First in snapshot order: among equal headline and time that is the earliest extraction.
    first = first_per_group(kept, ["published", "headline", key], ["date_extracted", *ties])
    return first.select(*columns).orderBy(*order_by([key, "-facebook_interactions", "link"]))


def sum_by_period(df: DataFrame, unit: str, column: str, measure: str) -> DataFrame:
    """Sum of a measure per year, month or week."""
    period = dates.period_start(column, unit).alias("period")
    return df.groupBy(period).agg(F.sum(measure).alias(f"sum_{measure}"))


def attach_extraction_date(
    predicted: DataFrame,
    extracted: DataFrame,
    on: Sequence[str] = ("published", "link", "facebook_interactions"),
) -> DataFrame:
    """Add the extraction date by three keys; a null key matches a null key."""
    right = extracted.select(*[F.col(c).alias(f"_{c}") for c in on], "date_extracted")
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return predicted.join(right, condition, "left").drop(*[f"_{c}" for c in on])
