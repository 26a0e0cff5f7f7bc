"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulse.functions import values
from pulse.operators import articles as art
from pulse.operators import evaluate, features, labelling, models, ranking, snapshots
from pulse.operators.bootstrap import BOUNDS, PRIME
from pulse.operators.ordered import first_per_group, with_fill
from pulse.plans.checks import adapters as a
from pulse.plans.checks.registry import check, joined, r6
from pulse.plans.checks.selection import (
    _EVAL,
    _MODEL_PAIRS,
    _PRIORITIES,
    _TOPIC,
    SELECTED,
    _results,
    selected,
)


@check(
    "a01_filter_bounds",
    a.using(a.NEWS)
    + "SELECT max(facebook_interactions) AS max_fb_interactions, min(published) AS min_date, max(published) AS max_date FROM news",
)
def filter_bounds(spark, folder):
    return art.filter_bounds(a.news(spark, folder))


@check("a01_domain_list", a.using(a.NEWS) + 'SELECT domain, count(*) AS "count" FROM news GROUP BY domain')
def domain_list(spark, folder):
    return art.domain_list(a.news(spark, folder))


@check("a02_frequencies", a.using(a.SNAPS) + 'SELECT "index", count(*) AS "count" FROM snaps GROUP BY 1')
def frequencies(spark, folder):
    return ranking.frequencies(a.snapshots(spark, folder), "index")


@check(
    "a03_top_labels",
    "WITH " + SELECTED + """
SELECT themes, CAST(sum(facebook_interactions) AS BIGINT) AS facebook_interactions, count(*) AS "count"
FROM (SELECT unnest(themes) AS themes, facebook_interactions FROM sel) GROUP BY themes
ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_labels(spark, folder):
    return art.top_labels(art.filled_lists(selected(spark, folder)), "themes", 20)


@check(
    "a03_top_indexes",
    "WITH " + SELECTED + """
SELECT indexes, CAST(sum(facebook_interactions) AS BIGINT) AS facebook_interactions, count(*) AS "count"
FROM (SELECT unnest(indexes) AS indexes, facebook_interactions FROM sel) GROUP BY indexes
ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_indexes(spark, folder):
    return art.top_labels(art.filled_lists(selected(spark, folder)), "indexes", 20)


_TOPICS = "WITH " + SELECTED + f", topics AS (SELECT *, {_TOPIC} AS main_topic FROM sel WHERE subindex IS NOT NULL)"


@check(
    "a04_topic_summary",
    _TOPICS + """, parts AS (
  SELECT main_topic, subindex, sum(facebook_interactions) AS total, count(*) AS articles FROM topics GROUP BY ALL)
SELECT main_topic, CAST(1 AS BIGINT) AS page,
       string_agg(subindex || ' (' || total || ' interactions)', '|' ORDER BY total DESC, subindex) AS subindex_counts,
       CAST(sum(total) AS BIGINT) AS facebook_interactions, CAST(sum(articles) AS BIGINT) AS "count"
FROM parts GROUP BY main_topic""",
)
def topic_summary(spark, folder):
    rows = art.topic_summary(art.filled_lists(selected(spark, folder)), _PRIORITIES)
    return rows.withColumn("subindex_counts", joined("subindex_counts"))


@check(
    "a04_topic_items",
    _TOPICS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY main_topic ORDER BY facebook_interactions DESC, facebook_link) AS n FROM topics)
SELECT main_topic, CAST((n - 1) // 20 + 1 AS BIGINT) AS page, string_agg(link, '|' ORDER BY n) AS links,
       string_agg(headline, '|' ORDER BY n) AS headlines, string_agg(summary, '|' ORDER BY n) AS fb_captions
FROM numbered GROUP BY ALL""",
)
def topic_items(spark, folder):
    rows = art.topic_items(art.filled_lists(selected(spark, folder)), _PRIORITIES, page_rows=20)
    return rows.withColumns({c: joined(c) for c in ("links", "headlines", "fb_captions")})


@check("a04_topic_rows", _TOPICS + "SELECT main_topic, facebook_link, facebook_interactions FROM topics")
def topic_rows(spark, folder):
    rows = art.topic_rows(art.filled_lists(selected(spark, folder)), _PRIORITIES)
    return rows.select("main_topic", "facebook_link", "facebook_interactions")


@check(
    "a05_kpis",
    a.using(a.SNAPS)
    + """SELECT count(DISTINCT theme) AS n_themes, count(DISTINCT "index") AS n_indexes, count(*) AS n_articles,
  CAST(sum(facebook_interactions) AS BIGINT) AS sum_interactions, round(avg(facebook_interactions), 2) AS mean_interactions
FROM snaps""",
)
def kpis(spark, folder):
    return art.kpis(a.snapshots(spark, folder), {"n_themes": "theme", "n_indexes": "index"})


@check(
    "a05_list_kpis",
    "WITH " + SELECTED + """
SELECT (SELECT count(DISTINCT t) FROM (SELECT unnest(themes) AS t FROM sel)) AS n_themes,
       (SELECT count(DISTINCT t) FROM (SELECT unnest(indexes) AS t FROM sel)) AS n_indexes, count(*) AS n_articles,
       CAST(sum(facebook_interactions) AS BIGINT) AS sum_interactions, round(avg(facebook_interactions), 2) AS mean_interactions
FROM sel""",
)
def list_kpis(spark, folder):
    return art.kpis(selected(spark, folder), {"n_themes": "themes", "n_indexes": "indexes"})


@check(
    "a06_daily_label_stats",
    "WITH " + SELECTED + """
SELECT themes, CAST(published AS DATE) AS day, round(avg(facebook_interactions), 6) AS facebook_interactions,
       count(facebook_interactions) AS "count", count(DISTINCT subindex) AS n_subindexes
FROM (SELECT unnest(themes) AS themes, published, facebook_interactions, subindex FROM sel) GROUP BY 1, 2""",
)
def daily_label_stats(spark, folder):
    rows = art.daily_label_stats(selected(spark, folder), "themes")
    return rows.withColumn("facebook_interactions", r6("facebook_interactions"))


@check(
    "a06_daily_label_subindexes",
    "WITH " + SELECTED + """
SELECT indexes, CAST(published AS DATE) AS day, CAST(1 AS BIGINT) AS page,
       string_agg(DISTINCT subindex, '|' ORDER BY subindex) AS subindexes
FROM (SELECT unnest(indexes) AS indexes, published, subindex FROM sel) WHERE subindex IS NOT NULL GROUP BY 1, 2""",
)
def daily_label_subindexes(spark, folder):
    rows = art.daily_label_subindexes(selected(spark, folder), "indexes")
    return rows.withColumn("subindexes", joined("subindexes"))


def _series_sql(dimension: str, how: str, expression: str, name: str) -> str:
    return (
        a.using(a.SNAPS)
        + f"""SELECT strftime(date_extracted, '%m-%d') AS month_day, {expression} AS {name}, {how} AS measure
FROM snaps GROUP BY 1, 2"""
    )


_PAIR = """theme || ' > ' || "index\""""


@check("a07_heatmap", _series_sql("theme_index", "round(avg(facebook_interactions), 6)", _PAIR, "theme_index"))
def heatmap(spark, folder):
    rows = snapshots.heatmap(a.snapshots(spark, folder), "theme_index")
    return rows.select("month_day", "theme_index", r6("mean_interactions").alias("measure"))


@check("a07_theme_heatmap", _series_sql("theme", "round(avg(facebook_interactions), 6)", "theme", "theme"))
def theme_heatmap(spark, folder):
    rows = snapshots.heatmap(a.snapshots(spark, folder), "theme")
    return rows.select("month_day", "theme", r6("mean_interactions").alias("measure"))


@check("a08_count_series", _series_sql("theme", "count(*)", "theme", "theme"))
def count_series(spark, folder):
    rows = snapshots.timeseries(a.snapshots(spark, folder), "theme", "count")
    return rows.select("month_day", "theme", F.col("count_interactions").alias("measure"))


@check("a08_sum_series", _series_sql("index", "CAST(sum(facebook_interactions) AS BIGINT)", '"index"', '"index"'))
def sum_series(spark, folder):
    rows = snapshots.timeseries(a.snapshots(spark, folder), "index", "sum")
    return rows.select("month_day", "index", F.col("sum_interactions").alias("measure"))


@check(
    "a08_label_counts_by_day",
    "WITH " + SELECTED + """
SELECT strftime(published, '%m-%d') AS month_day, themes, count(*) AS "count"
FROM (SELECT unnest(themes) AS themes, published FROM sel) GROUP BY 1, 2""",
)
def label_counts_by_day(spark, folder):
    return snapshots.label_counts_by_day(art.labels_long(selected(spark, folder), "themes"), "themes")


_CALENDAR = "SELECT date_extracted, round(avg(facebook_interactions), 6) AS facebook_interactions FROM snaps WHERE theme = 'click' GROUP BY 1"


@check("a09_calendar", a.using(a.SNAPS) + _CALENDAR)
def calendar(spark, folder):
    rows = snapshots.calendar(a.snapshots(spark, folder), "theme", ["click"])
    return rows.withColumn("facebook_interactions", r6("facebook_interactions"))


@check(
    "a09_calendar_cells",
    a.using(a.SNAPS)
    + """SELECT date_extracted, round(avg(facebook_interactions), 6) AS facebook_interactions,
  CAST(strftime(date_extracted, '%W') AS BIGINT) AS week, dayname(date_extracted) AS weekday,
  CAST(month(date_extracted) AS INTEGER) AS month FROM snaps GROUP BY date_extracted""",
)
def calendar_cells(spark, folder):
    rows = snapshots.calendar_cells(a.snapshots(spark, folder))
    return rows.withColumn("facebook_interactions", r6("facebook_interactions"))


@check(
    "a10_calendar_bounds",
    a.using(a.SNAPS)
    + """SELECT round(min(m), 6) AS min_y, round(max(m), 6) AS max_y
FROM (SELECT avg(facebook_interactions) AS m FROM snaps GROUP BY date_extracted)""",
)
def calendar_bounds(spark, folder):
    return snapshots.calendar_bounds(a.snapshots(spark, folder)).select(
        r6("min_y").alias("min_y"), r6("max_y").alias("max_y")
    )


def _change_sql(key: str, how: str) -> str:
    return (
        a.using(a.SNAPS)
        + f""", totals AS (SELECT {key}, date_extracted, {how}(facebook_interactions) AS v FROM snaps GROUP BY 1, 2),
before AS (SELECT *, lag(v) OVER (PARTITION BY {key} ORDER BY date_extracted) AS b FROM totals)
SELECT {key}, date_extracted, round(CAST(v AS DOUBLE), 6) AS facebook_interactions,
       round(coalesce(v / nullif(b, 0) - 1, 0) * 100, 6) AS pct_change, round(coalesce(CAST(v - b AS DOUBLE), 0), 6) AS abs_change
FROM before"""
    )


def _changes(rows):
    return rows.withColumns(
        {c: r6(F.col(c).cast("double")) for c in ("facebook_interactions", "pct_change", "abs_change")}
    )


@check("a11_mean_change", _change_sql("theme", "avg"))
def mean_change(spark, folder):
    return _changes(snapshots.aggregate_change(a.snapshots(spark, folder), "theme", "mean"))


@check("a11_sum_change", _change_sql('"index"', "sum"))
def sum_change(spark, folder):
    return _changes(snapshots.aggregate_change(a.snapshots(spark, folder), "index", "sum"))


@check(
    "a12_group_rank",
    a.using(a.SNAPS)
    + "SELECT theme, date_extracted, round(avg(facebook_interactions), 6) AS facebook_interactions FROM snaps GROUP BY 1, 2",
)
def group_rank(spark, folder):
    rows = snapshots.group_rank(a.snapshots(spark, folder), ["theme", "date_extracted"], "mean")
    return rows.withColumn("facebook_interactions", r6("facebook_interactions"))


@check(
    "a12_slider_bound",
    a.using(a.SNAPS)
    + "SELECT CAST(floor(max(m)) AS BIGINT) AS max_value FROM (SELECT avg(facebook_interactions) AS m FROM snaps GROUP BY theme, date_extracted)",
)
def slider_bound(spark, folder):
    ranked = snapshots.group_rank(a.snapshots(spark, folder), ["theme", "date_extracted"], "mean")
    return snapshots.slider_bound(ranked)


_SEEN = """, seen AS (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY headline DESC, published, date_extracted, event_id) AS day FROM snaps),
grads AS (
  SELECT link, avg(facebook_interactions) AS mean,
         CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(facebook_interactions, day) END AS gradient FROM seen GROUP BY link)"""


@check("a13_article_gradient", a.using(a.SNAPS) + _SEEN + "SELECT link, round(mean, 6) AS mean, round(gradient, 6) AS gradient FROM grads")
def article_gradient(spark, folder):
    rows = labelling.article_gradient(a.snapshots(spark, folder), ["event_id"])
    return rows.select("link", r6("mean").alias("mean"), r6("gradient").alias("gradient"))


def _vote_sql(label: str, weight: str = "1") -> str:
    return f"""SELECT article_index, {label} FROM (SELECT article_index, {label}, sum({weight}) AS w FROM preds GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY article_index ORDER BY w DESC, {label}) = 1"""


@check("a14_modal_label", a.using(a.PREDS) + _vote_sql("label"))
def modal_label(spark, folder):
    return labelling.modal_label(a.predictions(spark, folder), "label")


@check("a15_index_labels", a.using(a.PREDS) + _vote_sql("pred_y"))
def index_labels(spark, folder):
    return labelling.index_labels(a.predictions(spark, folder), "pred_y")


_WEIGHT = "CASE WHEN hours_since_published = 0 THEN 0 ELSE 1 / hours_since_published END"


@check(
    "a16_weighted_vote",
    a.using(a.PREDS)
    + f"SELECT t.article_index, t.label, p.pred_y FROM ({_vote_sql('label', _WEIGHT)}) t JOIN ({_vote_sql('pred_y', _WEIGHT)}) p ON t.article_index = p.article_index",
)
def weighted_vote(spark, folder):
    return labelling.vote_predictions(a.predictions(spark, folder), weighted=True)


@check(
    "a17_keep_large_groups",
    a.using(a.ARTICLES) + "SELECT doc_id, article_index FROM arts QUALIFY count(*) OVER (PARTITION BY article_index) >= 10",
)
def keep_large_groups(spark, folder):
    return ranking.keep_large_groups(a.articles(spark, folder), "article_index", 10).select("doc_id", "article_index")


@check(
    "a18_histogram",
    a.using(a.SNAPS)
    + """, ends AS (SELECT min(facebook_interactions) AS lo, max(facebook_interactions) AS hi FROM snaps),
binned AS (SELECT least(CAST(floor((facebook_interactions - lo) / ((hi - lo) / 100)) AS BIGINT) + 1, 100) AS bin FROM snaps, ends)
SELECT g.bin, round(lo + (g.bin - 1) * (hi - lo) / 100, 6) AS low, round(lo + g.bin * (hi - lo) / 100, 6) AS high,
       count(b.bin) AS "count"
FROM (SELECT unnest(range(1, 101)) AS bin) g CROSS JOIN ends LEFT JOIN binned b ON g.bin = b.bin GROUP BY g.bin, lo, hi""",
)
def histogram(spark, folder):
    rows = ranking.histogram(a.snapshots(spark, folder), "facebook_interactions", 100)
    return rows.select("bin", r6("low").alias("low"), r6("high").alias("high"), "count")


@check(
    "a18_density",
    a.using(a.SNAPS)
    + """, s AS (SELECT count(*) AS n, min(facebook_interactions) AS lo, max(facebook_interactions) AS hi,
  stddev_samp(facebook_interactions) * power(count(*), -0.2) AS h FROM snaps),
w AS (SELECT facebook_interactions AS v, count(*) AS c FROM snaps GROUP BY 1),
g AS (SELECT lo + i * (hi - lo) / 199 AS x FROM s, (SELECT unnest(range(0, 200)) AS i))
SELECT round(x, 6) AS x, round(1000000 * sum(c * exp(-power((x - v) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density
FROM g CROSS JOIN w CROSS JOIN s GROUP BY x""",
)
def density(spark, folder):
    rows = ranking.density(a.snapshots(spark, folder), "facebook_interactions")
    return rows.select(r6("x").alias("x"), r6(F.col("density") * 1000000).alias("density"))


def _activity(spark, folder):
    rows = a.snapshots(spark, folder)
    marks = rows.groupBy("link").agg((F.sum("facebook_interactions") % 3).cast("int").alias("label"))
    return labelling.activity_by_day(rows, marks, ["event_id"])


_ACTIVITY = _SEEN + """, marks AS (SELECT link, CAST(sum(facebook_interactions) % 3 AS INTEGER) AS label FROM snaps GROUP BY link),
act AS (SELECT s.*, m.label FROM seen s LEFT JOIN marks m ON s.link = m.link)"""


@check(
    "a19_activity_curve",
    a.using(a.SNAPS) + _ACTIVITY + """
SELECT day, label, round(avg(facebook_interactions), 6) AS mean_interactions, count(*) AS "count",
  round(avg(facebook_interactions) - 1.96 * coalesce(stddev_samp(facebook_interactions), 0) / sqrt(count(*)), 6) AS low,
  round(avg(facebook_interactions) + 1.96 * coalesce(stddev_samp(facebook_interactions), 0) / sqrt(count(*)), 6) AS high
FROM act GROUP BY 1, 2""",
)
def activity_curve(spark, folder):
    rows = labelling.activity_curve(_activity(spark, folder))
    return rows.withColumns({c: r6(c) for c in ("mean_interactions", "low", "high")})


_DRAWN = f"((((k3 * r + k2) % {PRIME}) * r + k1) % {PRIME} * r + k0) % {PRIME}"
_KEYS = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) % {PRIME} AS k{i}" for i in range(4))


@check(
    "a19_bootstrap_curve",
    a.using(a.SNAPS) + _ACTIVITY + f""",
keyed AS (SELECT day, label, facebook_interactions AS v, {_KEYS}
  FROM (SELECT *, md5(link || '|' || day) AS h FROM act WHERE label IS NOT NULL)),
drawn AS (SELECT day, label, v, r, {_DRAWN} AS u FROM keyed, (SELECT unnest(range(1, 1001)) AS r)),
weighed AS (SELECT day, label, v, r, {" + ".join(f"CAST(u >= {b} AS INTEGER)" for b in BOUNDS)} AS w FROM drawn),
means AS (SELECT day, label, r, sum(w * v) / nullif(sum(w), 0) AS m FROM weighed GROUP BY 1, 2, 3),
ends AS (SELECT day, label, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY 1, 2)
SELECT day, label, round(mean, 8) AS mean_interactions, "count", round(low, 8) AS low, round(high, 8) AS high
FROM (SELECT day, label, avg(facebook_interactions) AS mean, count(*) AS "count" FROM act WHERE label IS NOT NULL GROUP BY 1, 2)
JOIN ends USING (day, label)""",
)
def bootstrap_curve(spark, folder):
    rows = labelling.bootstrap_curve(_activity(spark, folder))
    return rows.withColumns({c: F.round(c, 8) for c in ("mean_interactions", "low", "high")})


_INDEX_DAYS = _SEEN + """, daily AS (
  SELECT "index" AS article_index, day, avg(facebook_interactions) AS v FROM seen GROUP BY 1, 2)"""


def _index_days(spark, folder):
    activity = _activity(spark, folder).withColumnRenamed("index", "article_index")
    return labelling.index_daily_activity(activity)


@check("a20_index_daily_activity", a.using(a.SNAPS) + _INDEX_DAYS + "SELECT article_index, day, round(v, 6) AS facebook_interactions FROM daily")
def index_daily_activity(spark, folder):
    rows = _index_days(spark, folder)
    return rows.withColumn("facebook_interactions", r6("facebook_interactions"))


@check(
    "a21_binned_count_2d",
    """WITH ends AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT least(CAST(floor((l_quantity - a) / ((b - a) / 10)) AS BIGINT) + 1, 10) AS x_bin,
       least(CAST(floor((l_extendedprice - c) / ((d - c) / 10)) AS BIGINT) + 1, 10) AS y_bin, count(*) AS "count"
FROM lineitem, ends GROUP BY 1, 2""",
)
def binned_count_2d(spark, folder):
    return ranking.binned_count_2d(a.table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 10)


@check(
    "a22_sum_by_year",
    "SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1",
)
def sum_by_year(spark, folder):
    rows = snapshots.sum_by_period(a.table(spark, folder, "orders"), "year", "o_orderdate", "o_totalprice")
    return rows.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@check(
    "a22_sum_by_month",
    "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1",
)
def sum_by_month(spark, folder):
    rows = snapshots.sum_by_period(a.table(spark, folder, "orders"), "month", "o_orderdate", "o_totalprice")
    return rows.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@check(
    "a23_themes_by_total",
    a.using(a.SNAPS) + "SELECT theme, CAST(sum(facebook_interactions) AS BIGINT) AS facebook_interactions FROM snaps GROUP BY 1",
)
def themes_by_total(spark, folder):
    return snapshots.themes_by_total(a.snapshots(spark, folder))


@check(
    "a24_confusion",
    a.using(a.PREDS)
    + """SELECT y.c AS label, p.c AS pred_y, count(preds.label) AS "count"
FROM (VALUES (0), (1), (2)) y(c) CROSS JOIN (VALUES (0), (1), (2)) p(c)
LEFT JOIN preds ON preds.label = y.c AND preds.pred_y = p.c GROUP BY 1, 2""",
)
def confusion(spark, folder):
    return evaluate.confusion(a.predictions(spark, folder))


@check("a25_evaluate", a.using(a.PREDS) + _EVAL.format(pairs=_MODEL_PAIRS["guess"]))
def evaluate_predictions(spark, folder):
    return evaluate.evaluate(a.predictions(spark, folder))


_RANKED = """, ranked AS (
  SELECT label, CASE WHEN pred_y = 0 THEN [0, 1, 2] WHEN pred_y = 1 THEN [1, 2, 0] ELSE [2, 0, 1] END AS suggested_labels FROM preds)"""


@check(
    "a26_top_k_accuracy",
    a.using(a.PREDS) + _RANKED + """
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN list_position(suggested_labels, label) BETWEEN 1 AND k THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM ranked CROSS JOIN (SELECT unnest(range(1, 3)) AS k) GROUP BY k""",
)
def top_k_accuracy(spark, folder):
    rows = a.predictions(spark, folder)
    ranked = rows.withColumn(
        "suggested_labels",
        F.array(F.col("pred_y"), (F.col("pred_y") + 1) % 3, (F.col("pred_y") + 2) % 3),
    )
    return evaluate.top_k_accuracy(ranked, 3).withColumn("accuracy", r6("accuracy"))


@check(
    "a27_class_report",
    a.using(a.PREDS)
    + """, classes AS (SELECT unnest([0, 1, 2]) AS c),
counts AS (
  SELECT c, sum(CASE WHEN label = c AND pred_y = c THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN pred_y = c THEN 1 ELSE 0 END) AS predicted,
         sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS actual FROM preds CROSS JOIN classes GROUP BY c),
m AS (
  SELECT c, hits, CAST(actual AS BIGINT) AS support, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p,
         CASE WHEN actual = 0 THEN 0 ELSE hits / actual END AS r, 2 * hits / (predicted + actual) AS f
  FROM counts WHERE predicted + actual > 0)
SELECT CAST(c AS VARCHAR) AS name, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
)
def class_report(spark, folder):
    rows = evaluate.class_report(a.predictions(spark, folder))
    return rows.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@check("a28_group_sizes", a.using(a.ARTICLES) + 'SELECT article_index, count(link) AS "count" FROM arts GROUP BY 1')
def group_sizes(spark, folder):
    return ranking.group_sizes(a.articles(spark, folder), "article_index", "link")


_LAGGED = """, lagged AS (
  SELECT *, lag(facebook_interactions) OVER (PARTITION BY link ORDER BY headline DESC, published, date_extracted, event_id) AS b FROM snaps)"""


@check("w01_abs_change", a.using(a.SNAPS) + _LAGGED + "SELECT event_id, coalesce(facebook_interactions - b, 0) AS facebook_interactions_abs_change FROM lagged")
def abs_change(spark, folder):
    rows = snapshots.article_changes(a.snapshots(spark, folder), ["event_id"])
    return rows.select("event_id", "facebook_interactions_abs_change")


@check(
    "w02_pct_change",
    a.using(a.SNAPS) + _LAGGED
    + "SELECT event_id, coalesce(facebook_interactions / nullif(b, 0) - 1, 0) AS facebook_interactions_pct_change FROM lagged",
)
def pct_change(spark, folder):
    rows = snapshots.article_changes(a.snapshots(spark, folder), ["event_id"])
    return rows.select("event_id", "facebook_interactions_pct_change")


@check("w03_index_mean_change", _change_sql('"index"', "avg"))
def index_mean_change(spark, folder):
    return _changes(snapshots.aggregate_change(a.snapshots(spark, folder), "index", "mean"))


@check(
    "w04_hours_since_previous",
    a.using(a.ARTICLES)
    + """SELECT doc_id, round(coalesce((epoch_us(published) - lag(epoch_us(published)) OVER (PARTITION BY article_index ORDER BY published, doc_id)) / 3.6e9, 0), 6) AS hours_since_published FROM arts""",
)
def hours_since_previous(spark, folder):
    rows = features.hours_since_previous(a.articles(spark, folder), "article_index", ["doc_id"])
    return rows.select("doc_id", r6("hours_since_published").alias("hours_since_published"))


@check("w05_activity_by_day", a.using(a.SNAPS) + _ACTIVITY + "SELECT event_id, day, label FROM act")
def activity_by_day(spark, folder):
    return _activity(spark, folder).select("event_id", "day", "label")


@check(
    "w06_top_groups_per_bucket",
    a.using(a.SNAPS)
    + """, c AS (SELECT CAST(hour(published) AS INTEGER) AS hour, domain, count("index") AS "count" FROM snaps GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY hour ORDER BY "count" DESC, domain) <= 3""",
)
def top_groups_per_bucket(spark, folder):
    rows = a.snapshots(spark, folder).withColumn("hour", F.hour("published"))
    return ranking.top_groups_per_bucket(rows, "hour", "domain", "index", 3)


_BLANKED = """sheet AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS theme,
         CASE WHEN o_totalprice > 200000 THEN o_custkey END AS idx FROM orders)"""


@check(
    "w07_forward_fill",
    "WITH " + _BLANKED + """
SELECT o_orderkey, last_value(theme IGNORE NULLS) OVER w AS theme, last_value(idx IGNORE NULLS) OVER w AS idx
FROM sheet WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill(spark, folder):
    rows = a.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("theme"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_custkey")).alias("idx"),
    )
    return with_fill(rows, [], ["o_orderkey"], ["theme", "idx"])


@check(
    "w08_first_snapshot",
    a.using(a.SNAPS)
    + """SELECT event_id, headline, date_extracted FROM snaps
QUALIFY row_number() OVER (PARTITION BY headline ORDER BY date_extracted, published, event_id) = 1""",
)
def first_snapshot(spark, folder):
    rows = first_per_group(a.snapshots(spark, folder), ["headline"], ["date_extracted", "published", "event_id"])
    return rows.select("event_id", "headline", "date_extracted")


@check(
    "w09_unique_articles",
    a.using(a.ARTICLES)
    + """, firsts AS (SELECT * FROM arts QUALIFY row_number() OVER (PARTITION BY headline, published ORDER BY date_extracted, doc_id) = 1)
SELECT doc_id, article_index FROM firsts QUALIFY count(*) OVER (PARTITION BY article_index) > 1""",
)
def unique_articles(spark, folder):
    return features.unique_articles(a.articles(spark, folder), ["doc_id"]).select("doc_id", "article_index")


@check("w10_arg_max", a.using(a.PREDS) + _vote_sql("label", _WEIGHT))
def arg_max(spark, folder):
    rows = a.predictions(spark, folder)
    return labelling.vote(rows, "label", weight=values.reciprocal("hours_since_published"))


@check("x10_class_codes", a.using(a.ARTICLES) + "SELECT doc_id, article_index, dense_rank() OVER (ORDER BY article_index) - 1 AS label_class FROM arts")
def class_codes(spark, folder):
    rows = a.articles(spark, folder).select("doc_id", "article_index")
    return models.class_codes(rows, "article_index")


@check(
    "x14_project_index",
    a.using(a.SNAPS) + _INDEX_DAYS + """, lines AS (
  SELECT article_index, regr_slope(v, day) AS s, regr_intercept(v, day) AS i, max(day) AS last FROM daily GROUP BY 1)
SELECT article_index, CAST(d AS BIGINT) AS day, round(i + s * (last + d), 6) AS forecast
FROM lines CROSS JOIN (SELECT unnest(range(1, 7)) AS d)""",
)
def project_index(spark, folder):
    rows = labelling.project_index(_index_days(spark, folder), 6)
    return rows.withColumn("forecast", r6("forecast"))


@check(
    "x17_compare_models",
    a.using(a.PREDS)
    + ", ".join([""] + [f"m_{m} AS (SELECT * FROM ({_EVAL.format(pairs=q)}))" for m, q in _MODEL_PAIRS.items()])
    + " SELECT 'constant' AS model, * FROM m_constant UNION ALL SELECT 'guess', * FROM m_guess",
)
def compare_models(spark, folder):
    return evaluate.compare_models(_results(spark, folder))


_INDEX_VOTES = f"SELECT t.label AS y, p.pred_y AS p FROM ({_vote_sql('label')}) t JOIN ({_vote_sql('pred_y')}) p ON t.article_index = p.article_index"


@check(
    "x17_evaluate_levels",
    a.using(a.PREDS)
    + f""", art AS (SELECT * FROM ({_EVAL.format(pairs=_MODEL_PAIRS["guess"])})), idx AS (SELECT * FROM ({_EVAL.format(pairs=_INDEX_VOTES)}))
SELECT 'article' AS level, * FROM art UNION ALL SELECT 'index', * FROM idx""",
)
def evaluate_levels(spark, folder):
    return evaluate.evaluate_levels(a.predictions(spark, folder))
