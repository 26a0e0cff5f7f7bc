"""What matters at scale can be read off the physical plan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pulse import session
from pulse.operators import articles, features, models, mutate, ranking, snapshots
from pulse.operators.ordered import paged_lists
from pulse.plans import articles as jobs
from pulse.plans.checks import adapters
from pulse.sources import files, sinks


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(frame) -> list[str]:
    return re.findall(r"FileScan parquet .*", plan(frame))


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    news = sinks.write_parquet(adapters.news(spark, data), str(folder / "news"))
    labels = sinks.write_parquet(adapters.labels(spark, data), str(folder / "labels"))
    return spark.read.parquet(news), spark.read.parquet(labels)


def test_article_filter_reaches_the_scan(stored):
    kept = articles.filter_articles(*stored, ["x"], 500, sort=False).select("facebook_link", "themes")
    scan = scans(kept)[0]
    assert "GreaterThanOrEqual(facebook_interactions,500)" in scan and "IsNotNull(headline)" in scan
    assert "summary" not in scan.split("ReadSchema")[1]


def test_top_labels_sum_before_the_shuffle(stored):
    top = articles.top_labels(articles.filled_lists(articles.filter_articles(*stored, sort=False)), "themes")
    text = plan(top)
    assert "TakeOrderedAndProject" in text and "partial_sum" in text
    assert "rangepartitioning" not in text


def test_training_reads_only_the_label(spark, stored, tmp_path):
    rows = stored[0].select("published", "headline", F.col("domain").alias("label"))
    path = sinks.write_parquet(rows, str(tmp_path / "train"))
    counts = ranking.keep_large_groups(files.read_training(spark, path).select("label"), "label", 2)
    assert all(scan.endswith("ReadSchema: struct<label:string>") for scan in scans(counts))


def test_deleting_a_source_prunes_folders(spark, stored, tmp_path):
    path = sinks.write_parquet(stored[0], str(tmp_path / "by-source"), ["source"])
    kept = spark.read.parquet(path).where("source = 'scan_en'")
    assert "PartitionFilters: [isnotnull(source" in scans(kept)[0]


def test_upsert_does_not_shuffle_the_stored_table(stored):
    news = stored[0].drop("source")
    text = plan(mutate.upsert_scan(stored[0], news, "scan_en"))
    # Kept rows come straight from the scan; keys that stay are the only stored column that moves.
    assert text.count("BroadcastHashJoin [facebook_link") >= 2
    assert not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*\n[^\n]*FileScan[^\n]*headline", text)


def test_large_upsert_moves_keys_only(spark, stored):
    batch = stored[0].withColumn("source", F.lit("new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(mutate.upsert_new_scans(stored[0], batch, 50))
        assert "SortMergeJoin" not in text and "Window" not in text and "Exchange hashpartitioning" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark, stored, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [
            spark.table(sinks.write_bucketed(frame, name, str(tmp_path / name), buckets=4))
            for frame, name in zip(stored, ("news_in_buckets", "labels_in_buckets"))
        ]
        text = plan(articles.with_labels(*tables))
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("news_in_buckets", "labels_in_buckets"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_large_lexicon_gives_the_same_scores(spark, data):
    texts = adapters.news(spark, data).select("facebook_link", "headline")
    lexicon = adapters.lexicon(spark, data)
    scored = [
        features.lexicon_scores(texts, "facebook_link", ["headline"], lexicon, rows).select(
            "facebook_link", F.round("headline_sentiment", 9), F.round("headline_subjectivity", 9)
        )
        for rows in (10, 10_000)
    ]
    assert sorted(map(tuple, scored[0].collect())) == sorted(map(tuple, scored[1].collect()))


def test_lag_needs_one_shuffle(spark, data):
    text = plan(snapshots.article_changes(adapters.snapshots(spark, data), ["event_id"]))
    assert text.count("Exchange ") == 1 and "Python" not in text


def test_fixed_tables_are_broadcast(spark, data):
    text = plan(features.with_traffic(adapters.snapshots(spark, data)))
    assert text.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in text


def test_words_are_cut_once_per_text(spark, data):
    counted = features.word_features(adapters.news(spark, data).select("facebook_link", "headline"), ["headline"])
    assert plan(counted).count("regexp_extract_all") == 1


def test_pages_bound_a_group(spark):
    rows = spark.range(100).withColumn("key", F.lit("one"))
    pages = paged_lists(rows, ["key"], ["id"], {"ids": "id"}, 30, hot_rows=20)
    assert sorted(len(r["ids"]) for r in pages.collect()) == [10, 30, 30, 30]


def test_shared_folder_is_read_from_the_session(spark):
    assert session.checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x").startswith(session.checkpoint_dir(spark))


def test_splits_move_keys_only(spark, data):
    rows = adapters.news(spark, data).select("facebook_link", "domain", "headline")
    text = plan(models.stratified_split(rows, "domain", "facebook_link"))
    assert "Exchange hashpartitioning" not in text and "Window" not in text  # the ends are broadcast


def test_numeric_features_order_no_texts(spark, data):
    rows = jobs.engineer_features(adapters.articles(spark, data), "doc_id", adapters.lexicon(spark, data), ["doc_id"])
    numbers = [c for c in rows.columns if c.endswith(("word_count", "sentiment", "published")) and c != "published"]
    frame = rows.select("doc_id", *numbers)
    tree = frame._jdf.queryExecution().optimizedPlan()
    windows = [node for node in _nodes(tree) if node.nodeName() == "Window"]
    assert len(windows) == 1
    assert not {"headline", "summary", "text"} & {a.name() for a in _items(windows[0].output())}


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(tree):
    return [tree, *[n for child in _items(tree.children()) for n in _nodes(child)]]
