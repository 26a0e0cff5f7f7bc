"""Article lists: filters, the label join, topics and counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import dates, values
from pulse.operators.ordered import order_by, paged_lists


def with_labels(news: DataFrame, labels: DataFrame) -> DataFrame:
    """Every article with its labels, if any; the article's own link is kept."""
    return news.join(labels.drop("link"), "facebook_link", "left")


def filter_articles(
    news: DataFrame,
    labels: DataFrame,
    excluded_domains: Sequence[str] = (),
    min_interactions: int = 100,
    between: tuple[dt.datetime, dt.datetime] | None = None,
    sort: bool = True,
) -> DataFrame:
    """Labelled articles by domain, engagement and time, most engaging first.

    An article without a domain is left out, as an SQL ``NOT IN`` would. The sort is
    a full shuffle: leave it out when the list feeds another aggregation.
    """
    kept = news.where(F.col("headline").isNotNull() & (F.col("facebook_interactions") >= min_interactions))
    kept = kept.where(~F.col("domain").isin(*excluded_domains) if excluded_domains else F.col("domain").isNotNull())
    if between:
        first, last = (F.lit(b.isoformat(sep=" ")).cast("timestamp_ntz") for b in between)
        kept = kept.where(F.col("published").between(first, last))
    joined = with_labels(kept, labels)
    return joined.orderBy(*order_by(["-facebook_interactions", "facebook_link"])) if sort else joined


def labelled_articles(news: DataFrame, labels: DataFrame, sort: bool = True) -> DataFrame:
    """Articles that carry at least one theme, one index or a subindex, oldest first."""
    used = (
        (F.coalesce(F.size("themes"), F.lit(0)) > 0)
        | (F.coalesce(F.size("indexes"), F.lit(0)) > 0)
        | F.col("subindex").isNotNull()
    )
    # The filter drops unmatched articles, so this is an inner join.
    joined = news.join(labels.drop("link").where(used), "facebook_link")
    return joined.orderBy(*order_by(["published", "facebook_link"])) if sort else joined


def filled_lists(df: DataFrame) -> DataFrame:
    """Null label lists become empty; ``themes_indexes`` is both lists in a row."""
    empty = F.array().cast("array<string>")
    filled = df.withColumns({c: F.coalesce(F.col(c), empty) for c in ("themes", "indexes")})
    return filled.withColumn("themes_indexes", F.concat("themes", "indexes"))


def filter_bounds(news: DataFrame) -> DataFrame:
    """Highest engagement and first and last time: one row."""
    return news.agg(
        F.max("facebook_interactions").alias("max_fb_interactions"),
        F.min("published").alias("min_date"),
        F.max("published").alias("max_date"),
    )


def domain_list(news: DataFrame) -> DataFrame:
    """Domains by number of articles."""
    counts = news.groupBy("domain").agg(F.count("*").alias("count"))
    return counts.orderBy(*order_by(["-count", "domain"]))


def labels_long(df: DataFrame, column: str) -> DataFrame:
    """One row per article and label; articles without a label vanish."""
    return df.withColumn(column, F.explode(column)).where(F.col(column).isNotNull())


def top_labels(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Labels with the most interactions."""
    totals = (
        labels_long(df, column)
        .groupBy(column)
        .agg(
            F.sum("facebook_interactions").alias("facebook_interactions"),
            F.count("facebook_interactions").alias("count"),
        )
    )
    return totals.orderBy(*order_by(["-facebook_interactions", column])).limit(n)


def with_main_topic(df: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """``main_topic``: the first priority label an article carries, else its subindex."""
    return df.withColumn(
        "main_topic", F.coalesce(values.first_of("themes_indexes", priorities), F.col("subindex"))
    )


def topic_summary(df: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """Totals per main topic with the totals of each of its subindexes, largest first."""
    topics = with_main_topic(df.where(F.col("subindex").isNotNull()), priorities)
    parts = topics.groupBy("main_topic", "subindex").agg(
        F.sum("facebook_interactions").alias("total"), F.count("facebook_interactions").alias("articles")
    )
    sums = parts.groupBy("main_topic").agg(
        F.sum("total").alias("facebook_interactions"), F.sum("articles").alias("count")
    )
    named = parts.withColumn("text", F.format_string("%s (%d interactions)", "subindex", "total"))
    # A topic may gather any number of subindex texts, so the lists are paged.
    lists = paged_lists(named, ["main_topic"], ["-total", "subindex"], {"subindex_counts": "text"})
    return lists.join(sums, "main_topic").orderBy(
        *order_by(["-facebook_interactions", "-main_topic", "page"])
    )


def topic_items(df: DataFrame, priorities: Sequence[str], page_rows: int = 1_000) -> DataFrame:
    """Headlines, captions and links per main topic, most engaging first, in pages."""
    topics = with_main_topic(df.where(F.col("subindex").isNotNull()), priorities)
    return paged_lists(
        topics,
        ["main_topic"],
        ["-facebook_interactions", "facebook_link"],
        {"headlines": "headline", "fb_captions": "summary", "links": "link"},
        page_rows,
    )


def topic_rows(df: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """The articles behind the topic summary, by topic and engagement."""
    topics = with_main_topic(df.where(F.col("subindex").isNotNull()), priorities)
    return topics.orderBy(*order_by(["main_topic", "-facebook_interactions", "facebook_link"]))


def kpis(df: DataFrame, distinct: dict[str, str]) -> DataFrame:
    """Row count, sum and mean of interactions, and distinct values of some columns: one row.

    ``distinct`` maps output names to columns; list columns are counted by item.
    """
    kinds = dict(df.dtypes)
    plain = {n: c for n, c in distinct.items() if not kinds[c].startswith("array")}
    totals = df.agg(
        *[F.count_distinct(c).alias(n) for n, c in plain.items()],
        F.count("*").alias("n_articles"),
        F.sum("facebook_interactions").alias("sum_interactions"),
        F.round(F.avg("facebook_interactions"), 2).alias("mean_interactions"),
    )
    for name, column in distinct.items():
        if name not in plain:
            items = df.select(F.explode(column).alias("item")).agg(F.count_distinct("item").alias("n"))
            totals = totals.withColumn(name, items.scalar())
    return totals.select(*distinct, "n_articles", "sum_interactions", "mean_interactions")


def daily_label_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, count and number of distinct subindexes per label and day."""
    long = labels_long(df.where(F.col("published").isNotNull()), column).withColumn("day", F.to_date("published"))
    return long.groupBy(column, "day").agg(
        F.avg("facebook_interactions").alias("facebook_interactions"),
        F.count("facebook_interactions").alias("count"),
        F.count_distinct("subindex").alias("n_subindexes"),
    )


def daily_label_subindexes(df: DataFrame, column: str, page_rows: int = 1_000) -> DataFrame:
    """Sorted set of subindexes per label and day, in pages."""
    long = labels_long(df, column).select(column, F.to_date("published").alias("day"), "subindex")
    names = long.where(F.col("subindex").isNotNull() & F.col("day").isNotNull()).distinct()
    return paged_lists(names, [column, "day"], ["subindex"], {"subindexes": "subindex"}, page_rows)


def assign_group_labels(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """Give every article of a subindex group the labels chosen for the group.

    ``assignments`` has one row per subindex; articles without a subindex are left out.
    """
    named = df.where(F.length("subindex") > 0).drop("themes", "indexes")
    return named.join(assignments.select("subindex", "themes", "indexes"), "subindex", "left")


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct labels of a list column."""
    return df.select(F.explode(column).alias(column)).where(F.col(column).isNotNull()).distinct().orderBy(column)


def group_label_lists(
    df: DataFrame, column: str, taxonomy: DataFrame | None = None, page_rows: int = 1_000
) -> DataFrame:
    """Sorted distinct labels of each subindex group, in pages; only those in the taxonomy if one is given.

    Used for the labels suggested for a group and for those its articles already have.
    """
    named = labels_long(df.where(F.length("subindex") > 0), column).select("subindex", F.col(column).alias("label"))
    pairs = named.distinct()
    if taxonomy is not None:
        allowed = taxonomy.select(F.col(taxonomy.columns[0]).alias("label"))
        pairs = pairs.join(allowed, "label", "left_semi")
    return paged_lists(pairs, ["subindex"], ["label"], {"labels": "label"}, page_rows)


def value_list(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a plain column, nulls left out."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def weekday_list(df: DataFrame, column: str) -> DataFrame:
    """Weekday names present in ``column``, Monday first."""
    days = df.select(dates.day_of_week(column).alias("day_number")).distinct()
    names = F.element_at(F.array(*[F.lit(d) for d in dates.WEEKDAYS]), F.col("day_number"))
    return days.select("day_number", names.alias("weekday")).orderBy("day_number")


def explore(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Filter any frame by column.

    A list or set keeps equal values, a pair keeps an inclusive range (None leaves
    a side open) and a string keeps text that matches it as a regular expression.
    """
    for name, wanted in filters.items():
        column = F.col(name)
        if isinstance(wanted, str):
            df = df.where(F.regexp_like(column, F.lit(wanted)))
        elif isinstance(wanted, tuple):
            low, high = wanted
            for bound, keep in ((low, lambda c, b: c >= b), (high, lambda c, b: c <= b)):
                if bound is not None:
                    df = df.where(keep(column, _literal(bound)))
        else:
            df = df.where(column.isin(*[_literal(v) for v in wanted]))
    return df


def _literal(value: object) -> Column:
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)
