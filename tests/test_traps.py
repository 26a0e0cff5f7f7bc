"""Small frames for the places where pandas, SQL and Spark differ."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pulse import schemas
from pulse.functions import dates, text, values
from pulse.operators import articles, evaluate, features, labelling, models, mutate, ranking, snapshots
from pulse.operators.ordered import order_by

DAY = dt.date(2024, 1, 1)


def snaps(spark, rows):
    """(link, day offset, interactions) as snapshots."""
    table = [
        (link, "h-" + link, dt.datetime(2024, 1, 1), DAY + dt.timedelta(days=day), count) for link, day, count in rows
    ]
    schema = "link string, headline string, published timestamp_ntz, date_extracted date, facebook_interactions long"
    return spark.createDataFrame(table, schema)


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_one_snapshot_has_no_slope_and_no_change(spark):
    row = one(snapshots.article_changes(snaps(spark, [("a", 0, 7)])))
    assert (row["facebook_interactions_abs_change"], row["facebook_interactions_pct_change"]) == (0, 0.0)
    assert one(labelling.article_gradient(snaps(spark, [("a", 0, 7)])))["gradient"] == 0.0


@pytest.mark.parametrize("infinite, last", [(False, 0.0), (True, math.inf)])
def test_change_from_zero(spark, infinite, last):
    rows = snapshots.article_changes(snaps(spark, [("a", 0, 0), ("a", 1, 0), ("a", 2, 5)]), infinite=infinite)
    found = [r["facebook_interactions_pct_change"] for r in rows.orderBy("date_extracted").collect()]
    assert found == [0.0, 0.0, last]


def test_mean_skips_nulls_but_slope_counts_them_as_zero(spark):
    row = one(labelling.article_gradient(snaps(spark, [("a", 0, None), ("a", 1, 4)])))
    assert (row["mean"], row["gradient"]) == (4.0, 4.0)


def test_rows_without_a_key_are_no_series(spark):
    rows = snaps(spark, [("a", 0, 3), ("b", 1, 9)]).withColumn("link", F.lit(None).cast("string"))
    changed = snapshots.article_changes(rows).collect()
    assert {r["facebook_interactions_abs_change"] for r in changed} == {0}
    assert labelling.article_gradient(rows).count() == 0
    timed = spark.createDataFrame(
        [(None, dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 2)), ("i", dt.datetime(2024, 1, 2))],
        "article_index string, published timestamp_ntz",
    )
    assert {r["hours_since_published"] for r in features.hours_since_previous(timed).collect()} == {0.0}


def test_clipping_keeps_null(spark):
    rows = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(values.clip_negative("v")).collect()] == [0.0, None, 2.0]


def news(spark, rows):
    table = [
        (dt.datetime(2024, 1, 1), f"h{k}", None, f"l{k}", f"fb{k}", None, domain, count, source)
        for k, domain, count, source in rows
    ]
    return spark.createDataFrame(table, schemas.NEWS_DATA)


def labels(spark, rows):
    return spark.createDataFrame([(f"l{k}", f"fb{k}", t, i, s) for k, t, i, s in rows], schemas.NEWS_LABELS)


@pytest.mark.parametrize("excluded", [[], ["y"]])
def test_article_filter_drops_missing_domain(spark, excluded):
    stored = news(spark, [(1, None, 500, "a"), (2, "x", 500, "a"), (3, "x", 1, "a")])
    kept = articles.filter_articles(stored, labels(spark, []), excluded)
    assert [r["facebook_link"] for r in kept.collect()] == ["fb2"]


def test_snapshot_filter_keeps_missing_theme(spark):
    rows = snaps(spark, [("a", 0, 900), ("b", 0, 900)]).withColumns(
        {"date": F.col("date_extracted"), "theme": F.when(F.col("link") == "a", "x"), "index": F.lit(None).cast("string")}
    )
    kept = snapshots.filter_snapshots(rows, 500, (DAY, DAY), ["x"], ["y"])
    assert [r["link"] for r in kept.collect()] == ["b"]


def test_nulls_in_groups_joins_and_sorts(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int")
    assert [tuple(r) for r in ranking.frequencies(rows, "k").collect()] == [("a", 2)]
    assert [r["k"] for r in rows.orderBy(*order_by(["k"])).collect()] == ["a", "a", None]
    assert [r["k"] for r in rows.orderBy(*order_by(["-k"])).collect()] == ["a", "a", None]
    right = spark.createDataFrame([(None, "d")], "k string, date_extracted string")
    matched = snapshots.attach_extraction_date(rows, right, ["k"])
    assert [r["date_extracted"] for r in matched.orderBy("v").collect()] == [None, "d", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_time_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        given = ["2024-01-01 23:30:00Z", "2024-01-01 23:30:00", "2024-01-01T23:30:00+08:00", "2024-01-01"]
        rows = spark.createDataFrame([(g,) for g in given], "t string").select(dates.to_local("t").alias("t"))
        assert [r["t"] for r in rows.collect()] == [
            dt.datetime(2024, 1, 2, 7, 30),
            dt.datetime(2024, 1, 2, 7, 30),
            dt.datetime(2024, 1, 1, 23, 30),
            dt.datetime(2024, 1, 1, 8, 0),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_month_day_folds_years(spark):
    rows = snaps(spark, [("a", 0, 10), ("a", 366, 30)]).withColumn("theme", F.lit("x"))
    assert one(snapshots.heatmap(rows, "theme"))["mean_interactions"] == 20.0
    assert snapshots.heatmap(rows, "theme", by="date").count() == 2


def test_equal_votes_go_to_the_smallest_label(spark):
    rows = spark.createDataFrame([("i", 2), ("i", 1), ("j", 0)], "article_index string, label int")
    assert {tuple(r) for r in labelling.modal_label(rows, "label").collect()} == {("i", 1), ("j", 0)}


def test_first_article_of_an_index_has_no_weight(spark):
    rows = spark.createDataFrame(
        [("i", 2, 0.0), ("i", 1, 4.0)], "article_index string, label int, hours_since_published double"
    )
    weighted = labelling.vote(rows, "label", weight=values.reciprocal("hours_since_published"))
    assert one(weighted)["label"] == 1


def test_topic_and_day_are_separate_memberships(spark):
    rows = snaps(spark, [("a", 0, 900), ("b", 1, 900), ("c", 1, 1), ("d", 0, 1), ("e", 2, 1)]).withColumn(
        "theme", F.when(F.col("link").isin("a", "c", "e"), "x").otherwise("y")
    )
    totals = spark.createDataFrame(
        [("x", DAY, 10.0), ("y", DAY + dt.timedelta(days=1), 10.0), ("x", DAY + dt.timedelta(days=2), 1.0)],
        "theme string, date_extracted date, v double",
    )
    kept = snapshots.articles_over_threshold(rows, totals, "theme", "v", 5)
    assert {r["link"] for r in kept.collect()} == {"a", "b", "c", "d"}


def test_sample_is_limited_before_it_is_sorted(spark):
    rows = spark.createDataFrame([(i, 100 + i) for i in range(20)], "id int, v int")
    sample = ranking.threshold_sample(rows, "v", 0, ["id"], n=3)
    assert [r["v"] for r in sample.collect()] == [102, 101, 100]


def test_indexed_rows_with_themes_alone(spark):
    empty = spark.createDataFrame([], schemas.NEWS_LABELS)
    batch = spark.createDataFrame(
        [("l1", "fb1", "a,b", None, None), ("l2", "fb2", None, "x, y", None)],
        "link string, facebook_link string, themes string, indexes string, subindex string",
    )
    row = one(mutate.load_labels(empty, batch))
    assert (row["facebook_link"], row["indexes"]) == ("fb2", ["x", " y"])
    assert mutate.load_labels(empty, batch, include_themes=True).count() == 2


def test_population_deviation(spark):
    from pulse.operators.scaling import fit_scaler

    rows = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert fit_scaler(rows, "v", "standard").spread == 1.0
    constant = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    for kind in ("standard", "minmax", "robust"):
        assert {r["v"] for r in fit_scaler(constant, "v", kind).transform(constant).collect()} == {0.0}


def test_class_that_is_never_predicted(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (0, 2)], "label int, pred_y int")
    row = one(evaluate.evaluate(rows))
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.333, 0.167, 0.167, 0.167)
    cells = evaluate.confusion(rows).collect()
    assert len(cells) == 9 and sum(c["count"] for c in cells) == 3


def test_top_k_stops_before_k(spark):
    rows = spark.createDataFrame([("a", ["b", "a"]), ("z", ["b", "a"])], "label string, suggested_labels array<string>")
    assert [tuple(r) for r in evaluate.top_k_accuracy(rows, 4).collect()] == [(1, 0.0), (2, 0.5), (3, 0.5)]


def test_taxonomy_sheet(spark):
    rows = spark.createDataFrame(
        [(1, "A", "x"), (2, None, "y"), (3, None, None), (4, "B", None), (5, "note", "note")],
        "pos int, theme string, index string",
    )
    assert [r["label"] for r in models.taxonomy_labels(rows, "pos").collect()] == ["A > x", "A > y", "B > y"]


def test_weekday_names_start_at_one(spark):
    rows = spark.createDataFrame([(1,), (7,)], "day_of_week_published int")
    named = [r[0] for r in features.bin_features(rows).collect()]
    assert named == ["Monday", "Sunday"]


def test_list_literals(spark):
    given = ["""['it\\'s > a', "b > c"]""", """["it's > a"]""", "[]", None]
    rows = spark.createDataFrame([(g,) for g in given], "t string")
    first = [r[0] for r in rows.select(text.first_literal_item("t")).collect()]
    assert first == ["it's > a", "it's > a", None, None]
    native = [r[0] for r in rows.select(text.literal_items("t")).collect()]
    assert native == [["it's > a", "b > c"], ["it's > a"], [], None]
    assert [r[0] for r in rows.select(text.parse_list_literal("t")).collect()] == native


def test_words_split_like_python(spark):
    given = ["a  b\tc", " \n", "x\x1cy z　w\x85v", "", "The the don't", "é è"]
    rows = spark.createDataFrame([(g,) for g in given], "t string")
    found = rows.select(text.words("t"), text.word_count("t"), text.unique_word_count("t")).collect()
    for g, (cut, count, unique) in zip(given, found):
        assert (cut, count, unique) == (g.split(), len(g.split()), len(set(g.split())))
    assert rows.select(text.non_stop_word_count("t")).collect()[4][0] == 0
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 179


def test_joined_text_counts_equal_separate_counts(spark):
    rows = spark.createDataFrame([("a the b", "b c a"), ("x", "")], "headline string, summary string")
    joined = rows.withColumn("text", text.join_text(F.col("headline"), F.col("summary")))
    alone = joined.select("text")
    columns = [f"text_{k}word_count" for k in ("", "non_stop_", "unique_")]
    both = features.word_features(joined).select(*columns).collect()
    assert both == features.word_features(alone, ["text"]).select(*columns).collect() == [(6, 3, 4), (1, 1, 1)]


def test_meta_tags(spark):
    pages = [
        '<meta name="a" content="n"><META content=\'it&amp;s "x"\' property="og:image">',
        "<meta property='og:image' content=\"it's\">",
        '<meta property="og:image:width" content="9">',
        '<meta property="og:image" content="">',
        '<meta property="og:image">',
        None,
    ]
    rows = spark.createDataFrame([(p,) for p in pages], "html string")
    found = [r[0] for r in rows.select(text.extract_meta("html", "og:image")).collect()]
    assert found == ['it&s "x"', "it's", None, "", None, None]


def test_kernel_density_integrates_to_one(spark):
    rows = spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double")
    points = ranking.density(rows, "v", 50).orderBy("x").collect()
    step = points[1]["x"] - points[0]["x"]
    assert 0.8 < sum(p["density"] for p in points) * step < 1.05


def test_histogram_keeps_the_upper_edge(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "v double")
    bins = [r["count"] for r in ranking.histogram(rows, "v", 2).orderBy("bin").collect()]
    assert bins == [1, 2]


def test_main_topic_and_group_labels(spark):
    rows = articles.filled_lists(
        articles.with_labels(
            news(spark, [(1, "x", 5, "a"), (2, "x", 7, "a"), (3, "x", 9, "a")]),
            labels(spark, [(1, ["t"], ["p"], "s"), (2, None, ["p", "q"], ""), (3, ["q"], None, None)]),
        )
    )
    topics = articles.with_main_topic(rows, ["q", "t"]).orderBy("facebook_link").collect()
    assert [r["main_topic"] for r in topics] == ["t", "q", "q"]
    chosen = spark.createDataFrame([("s", ["new"], ["i"])], "subindex string, themes array<string>, indexes array<string>")
    row = one(articles.assign_group_labels(rows.drop("themes_indexes"), chosen))
    assert (row["facebook_link"], row["themes"]) == ("fb1", ["new"])
