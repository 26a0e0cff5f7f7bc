"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions import dates, text
from pulse.operators import features, labelling, scaling, snapshots
from pulse.operators.ordered import HOT_ROWS
from pulse.session import settle

SNAPSHOT_COLUMNS = [
    "published",
    "date",
    "time",
    "date_extracted",
    "headline",
    "summary",
    "link",
    "domain",
    "facebook_interactions",
    "facebook_interactions_abs_change",
    "facebook_interactions_pct_change",
    "theme",
    "index",
]


def process_snapshots(df: DataFrame, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Raw snapshots to the dashboard's rows: labels, day and time, change since the last snapshot."""
    parsed = snapshots.parse_labels(df).withColumns(
        {
            "date": dates.date_part("published"),
            "time": dates.time_part("published"),
            "date_extracted": dates.date_part("date_extracted"),
        }
    )
    changed = snapshots.article_changes(parsed, ties, hot_rows=hot_rows)
    return changed.select(*SNAPSHOT_COLUMNS, *ties)


def engineer_features(
    df: DataFrame,
    key: str = "link",
    lexicon: DataFrame | None = None,
    ties: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Features of unique articles; rows with a null in any column are left out.

    The gap to the previous article of the index is taken before any domain filter. Words are counted and texts
    checked for nulls before rows are ordered, so texts that the caller does not select stay out of that shuffle.
    """
    joined = df.withColumn("text", text.join_text(F.col("headline"), F.col("summary")))
    whole = reduce(and_, [F.col(c).isNotNull() for c in features.TEXTS])
    counted = features.word_features(joined).withColumn("_whole", whole)
    timed = features.timing_features(features.hours_since_previous(counted, "article_index", ties, hot_rows))
    if lexicon is not None:
        timed = features.lexicon_scores(timed, key, features.TEXTS, lexicon)
    columns = dict.fromkeys([*joined.columns, "hours_since_published", "day_of_week_published", "hour_of_day_published", *timed.columns])
    checked = [c for c in columns if c not in (*features.TEXTS, "_whole")]
    return timed.select(*columns).where("_whole").dropna(subset=checked).drop("_whole")


def prepare_articles(
    snapshot_rows: DataFrame,
    key: str = "link",
    lexicon: DataFrame | None = None,
    ties: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Unique articles with features, publisher group and traffic; unknown publishers leave last."""
    unique = features.unique_articles(snapshot_rows, ties)
    engineered = engineer_features(unique, key, lexicon, ties, hot_rows)
    return features.with_traffic(features.keep_known_domains(engineered))


def label_articles(
    articles: DataFrame, snapshot_rows: DataFrame, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean and slope per article, all scaled forms, and the traction label.

    The scalers read their input several times, so it is written out once.
    """
    gradients = labelling.article_gradient(snapshot_rows, ties, hot_rows)
    merged = settle(labelling.merge_gradients(articles, gradients))
    scaled = scaling.normalise(merged)
    return scaled.withColumn("label", labelling.traction_label("gradient_pt_scaled", "mean_pt_scaled"))
