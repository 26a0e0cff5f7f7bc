"""Gradient labels of articles, votes of indexes and activity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import values
from pulse.operators.bootstrap import bootstrap_means
from pulse.operators.ordered import HOT_ROWS, first_per_group, order_by, with_row_number
from pulse.operators.snapshots import ARTICLE_ORDER


def article_gradient(df: DataFrame, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean interactions per article and slope against the observation number; one observation has slope 0."""
    known = df.where(F.col("link").isNotNull())
    numbered = with_row_number(known, ["link"], [*ARTICLE_ORDER, *ties], "_seen", hot_rows)
    value = values.nan_to_zero("facebook_interactions")
    return numbered.groupBy("link").agg(
        F.avg("facebook_interactions").alias("mean"),
        F.coalesce(F.regr_slope(value, F.col("_seen").cast("double")), F.lit(0.0)).alias("gradient"),
    )


def merge_gradients(articles: DataFrame, gradients: DataFrame) -> DataFrame:
    """Add mean and slope to unique articles; a falling slope counts as 0."""
    joined = articles.join(gradients, "link", "left")
    return joined.withColumn("gradient", values.clip_negative("gradient"))


def traction_label(
    gradient: str | Column, mean: str | Column, upper: float = 1.0, lower: float = -1.0
) -> Column:
    """``trending``, ``diminishing`` or ``neutral`` from two scaled values."""
    slope, level = (F.col(c) if isinstance(c, str) else c for c in (gradient, mean))
    return (
        F.when((slope > upper) | (level > upper), "trending")
        .when((slope < lower) | (level < lower), "diminishing")
        .otherwise("neutral")
    )


def merge_labels(snapshots: DataFrame, labelled: DataFrame) -> DataFrame:
    """Give every snapshot the label of its article."""
    return snapshots.join(labelled.select("link", "label"), "link", "left")


def activity_by_day(
    snapshots: DataFrame, labelled: DataFrame, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Snapshots with their article's label and the number of the observation, from 1."""
    numbered = with_row_number(snapshots, ["link"], [*ARTICLE_ORDER, *ties], "day", hot_rows)
    return merge_labels(numbered, labelled)


def activity_curve(activity: DataFrame) -> DataFrame:
    """Mean interactions per day number and label with a 95 % interval of the mean."""
    known = activity.where(F.col("label").isNotNull())
    stats = known.groupBy("day", "label").agg(
        F.avg("facebook_interactions").alias("mean_interactions"),
        F.stddev_samp("facebook_interactions").alias("_spread"),
        F.count("facebook_interactions").alias("count"),
    )
    margin = 1.96 * F.coalesce("_spread", F.lit(0.0)) / F.sqrt("count")
    return stats.withColumns(
        {"low": F.col("mean_interactions") - margin, "high": F.col("mean_interactions") + margin}
    ).drop("_spread")


def bootstrap_curve(activity: DataFrame, replicates: int = 1_000) -> DataFrame:
    """Mean interactions per day number and label with a 95 % bootstrap interval; an observation is a link and its number."""
    known = activity.where(F.col("label").isNotNull())
    made = bootstrap_means(known, ["day", "label"], "facebook_interactions", ["link", "day"], replicates)
    return made.withColumnRenamed("mean_facebook_interactions", "mean_interactions")


def index_daily_activity(activity: DataFrame) -> DataFrame:
    """Mean interactions per index and day number."""
    known = activity.where(F.col("article_index").isNotNull())
    return known.groupBy("article_index", "day").agg(F.avg("facebook_interactions").alias("facebook_interactions"))


def project_index(daily: DataFrame, steps: int = 6) -> DataFrame:
    """Straight-line projection of every index for the days after its last one."""
    lines = daily.groupBy("article_index").agg(
        F.regr_slope("facebook_interactions", F.col("day").cast("double")).alias("_slope"),
        F.regr_intercept("facebook_interactions", F.col("day").cast("double")).alias("_start"),
        F.avg("facebook_interactions").alias("_mean"),
        F.max("day").alias("_last"),
    )
    ahead = lines.withColumn("day", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    line = F.col("_start") + F.col("_slope") * (F.col("_last") + F.col("day"))
    return ahead.select("article_index", "day", F.coalesce(line, F.col("_mean")).alias("forecast"))


def vote(df: DataFrame, label: str, key: str = "article_index", weight: Column | None = None) -> DataFrame:
    """Label with the most votes per index; ties go to the smallest label.

    Votes weigh 1 unless a weight is given. Votes are summed per label before the
    choice, so a group is at most as large as the number of labels.
    """
    known = df.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    votes = known.groupBy(key, label).agg(F.sum(F.lit(1) if weight is None else weight).alias("_votes"))
    return first_per_group(votes, [key], ["-_votes", label]).select(key, label)


def modal_label(df: DataFrame, label: str, key: str = "article_index") -> DataFrame:
    """Most frequent label per index."""
    return vote(df, label, key)


def index_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Majority label per index, highest label first."""
    return vote(df, label).orderBy(*order_by([f"-{label}", "article_index"]))


def vote_predictions(df: DataFrame, weighted: bool = False, hours: str = "hours_since_published") -> DataFrame:
    """True and predicted label per index, by majority or weighted by 1 / hours since the previous article."""
    weight = values.reciprocal(hours) if weighted else None
    return vote(df, "label", weight=weight).join(vote(df, "pred_y", weight=weight), "article_index")
