"""Answers from daily rollups, next to the SQL that gives the same rows from the raw ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulse.operators import rollup
from pulse.plans.checks import adapters as a
from pulse.plans.checks.measures import _change_sql, _changes, _series_sql
from pulse.plans.checks.registry import check, r6
from pulse.plans.checks.selection import SELECTED, selected
from pulse.session import scratch_path


def _stored(spark, rows, key, day, dimensions, counted):
    """A rollup that got the rows in two batches, the second one twice."""
    path = scratch_path(spark, "rollup")
    odd = F.pmod(F.xxhash64(key), F.lit(2)) == 1
    for name, batch in (("first", rows.where(~odd)), ("second", rows.where(odd)), ("second", rows.where(odd))):
        table = rollup.add(spark, path, batch, name, day, dimensions, counted)
    return table.read()


def _snapshots(spark, folder):
    names = {"theme": "theme", "index": "index"}
    return _stored(spark, a.snapshots(spark, folder), "event_id", "date_extracted", names, {"": ["theme", "index"]})


def _articles(spark, folder):
    names = {"themes": "themes", "indexes": "indexes"}
    return _stored(spark, selected(spark, folder), "facebook_link", "published", names, {"": ["themes", "indexes"], "themes": ["subindex"]})


@check(
    "a05_rollup_kpis",
    a.using(a.SNAPS)
    + """SELECT count(DISTINCT theme) AS n_themes, count(DISTINCT "index") AS n_indexes, count(*) AS n_articles,
  CAST(sum(facebook_interactions) AS BIGINT) AS sum_interactions, round(avg(facebook_interactions), 2) AS mean_interactions
FROM snaps WHERE date_extracted BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'""",
)
def kpis(spark, folder):
    chosen = rollup.between(_snapshots(spark, folder), "2024-01-03", "2024-01-20")
    return rollup.kpis(chosen, {"n_themes": "theme", "n_indexes": "index"})


@check(
    "a05_rollup_list_kpis",
    "WITH " + SELECTED + """
SELECT (SELECT count(DISTINCT t) FROM (SELECT unnest(themes) AS t FROM sel)) AS n_themes,
       (SELECT count(DISTINCT t) FROM (SELECT unnest(indexes) AS t FROM sel)) AS n_indexes, count(*) AS n_articles,
       CAST(sum(facebook_interactions) AS BIGINT) AS sum_interactions, round(avg(facebook_interactions), 2) AS mean_interactions
FROM sel""",
)
def list_kpis(spark, folder):
    return rollup.kpis(_articles(spark, folder), {"n_themes": "themes", "n_indexes": "indexes"})


@check(
    "a06_rollup_label_stats",
    "WITH " + SELECTED + """
SELECT themes, CAST(published AS DATE) AS day, round(avg(facebook_interactions), 6) AS facebook_interactions,
       count(facebook_interactions) AS "count", count(DISTINCT subindex) AS n_subindex
FROM (SELECT unnest(themes) AS themes, published, facebook_interactions, subindex FROM sel) GROUP BY 1, 2""",
)
def label_stats(spark, folder):
    rows = rollup.label_stats(_articles(spark, folder), "themes", "subindex")
    return rows.withColumn("facebook_interactions", r6("facebook_interactions"))


@check("a08_rollup_series", _series_sql("index", "CAST(sum(facebook_interactions) AS BIGINT)", '"index"', '"index"'))
def sum_series(spark, folder):
    rows = rollup.series(_snapshots(spark, folder), "index", "sum")
    return rows.select("month_day", "index", F.col("sum_interactions").alias("measure"))


@check("a11_rollup_change", _change_sql("theme", "avg"))
def mean_change(spark, folder):
    return _changes(rollup.change(_snapshots(spark, folder), "theme", "mean"))
