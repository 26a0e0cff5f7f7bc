"""Sources and sinks: each query writes the tables in one format and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulse import schemas
from pulse.operators.mutate import union_all
from pulse.operators.ordered import first_per_group
from pulse.operators.snapshots import attach_extraction_date
from pulse.plans.checks import adapters as a
from pulse.plans.checks.registry import check
from pulse.session import scratch_path
from pulse.sources import files, sinks, sql


def _scan(news):
    """Articles under the headers of a weekly scan."""
    return news.select(
        F.concat(F.date_format("published", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")).alias("Published"),
        F.col("headline").alias("Headline"),
        F.col("summary").alias("Summary"),
        F.col("facebook_link").alias("Link"),
        F.col("link").alias("Link URL"),
        F.col("facebook_page_name").alias("Facebook Page Name"),
        F.col("domain").alias("Domain"),
        F.col("facebook_interactions").alias("Total Interactions"),
    )


_SCAN_SQL = a.using(a.NEWS) + """
SELECT published + INTERVAL 8 HOUR AS published, headline, summary, link, facebook_link, facebook_page_name,
       domain, facebook_interactions FROM news"""


@check("s01_read_scan", _SCAN_SQL)
def read_scan(spark, folder):
    path = sinks.write_csv(_scan(a.news(spark, folder)), scratch_path(spark, "scan"))
    return files.read_scan(spark, path)


_INDEXED_SQL = a.using(a.LABELS) + """
SELECT link, facebook_link, array_to_string(themes, ',') AS themes, array_to_string(indexes, ',') AS indexes,
       subindex FROM labs"""


@check("s02_read_indexed_xlsx", _INDEXED_SQL)
def read_indexed_xlsx(spark, folder):
    rows = a.labels(spark, folder).withColumns({c: F.array_join(c, ",") for c in ("themes", "indexes")})
    return files.read_workbooks(sinks.to_workbooks(rows), schemas.INDEXED_COLUMNS)


@check("s03_read_indexed", _INDEXED_SQL)
def read_indexed(spark, folder):
    path = sinks.write_csv(a.labels(spark, folder), scratch_path(spark, "indexed"))
    return files.read_indexed(spark, path)


@check("s04_taxonomy", a.using(a.TAXONOMY) + 'SELECT DISTINCT lower("index") AS "index" FROM taxo WHERE "index" IS NOT NULL')
def taxonomy(spark, folder):
    return files.load_taxonomy(a.taxonomy(spark, folder), "index")


_RAW_SQL = a.using(a.SNAPS) + """
SELECT link, published, headline, summary, domain, facebook_interactions, date_extracted,
       '[''' || theme || ' > ' || "index" || ''', "other''s > x"]' AS suggested_labels FROM snaps"""


@check("s05_read_snapshots", _RAW_SQL)
def read_snapshots(spark, folder):
    path = sinks.write_csv(a.raw_snapshots(spark, folder), scratch_path(spark, "snapshots"))
    return files.read_snapshots(spark, path)


@check("s06_read_snapshots_json", _RAW_SQL)
def read_snapshots_json(spark, folder):
    path = sinks.write_json(a.raw_snapshots(spark, folder), scratch_path(spark, "snapshots-json"))
    return files.read_snapshots_json(spark, path)


def _training(spark, folder):
    return a.articles(spark, folder).select(
        "published", "headline", F.concat("article_theme", F.lit(" > "), "article_index").alias("label")
    )


@check(
    "s07_read_training",
    a.using(a.ARTICLES)
    + "SELECT article_theme || ' > ' || article_index AS label, count(*) AS \"count\" FROM arts GROUP BY 1",
)
def read_training(spark, folder):
    path = sinks.write_parquet(_training(spark, folder), scratch_path(spark, "training"))
    return files.read_training(spark, path).groupBy("label").count()


@check("s08_write_parquet", a.using(a.LABELS) + "SELECT facebook_link, link, subindex FROM labs WHERE subindex IS NOT NULL")
def write_parquet(spark, folder):
    rows = a.labels(spark, folder).where(F.col("subindex").isNotNull())
    path = sinks.write_parquet(rows, scratch_path(spark, "export"), ["subindex"])
    return spark.read.parquet(path).select("facebook_link", "link", "subindex")


@check("s09_write_csv", a.using(a.TAXONOMY) + 'SELECT DISTINCT lower(theme) AS theme FROM taxo')
def write_csv(spark, folder):
    import datetime as dt

    themes = files.load_taxonomy(a.taxonomy(spark, folder), "theme")
    path = sinks.write_csv(themes, scratch_path(spark, "versions"), dt.date(2024, 1, 1))
    return files.read_text_csv(spark, path)


@check(
    "s10_to_workbooks",
    a.using(a.SNAPS) + "SELECT CAST(event_id AS VARCHAR) AS event_id, link, CAST(facebook_interactions AS VARCHAR) AS facebook_interactions FROM snaps",
)
def to_workbooks(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "link", "facebook_interactions")
    return files.read_workbooks(sinks.to_workbooks(rows, 50_000), rows.columns)


@check("s11_read_table", a.using(a.NEWS) + "SELECT facebook_link, published, facebook_interactions FROM news")
def read_table(spark, folder):
    path = sinks.write_parquet(a.news(spark, folder), scratch_path(spark, "table"))
    there = files.read_table(spark, path, schemas.NEWS_DATA)
    absent = files.read_table(spark, scratch_path(spark, "absent"), schemas.NEWS_DATA)
    return union_all(absent, there).select("facebook_link", "published", "facebook_interactions")


@check("s12_ledger")
def ledger(spark, folder):
    return files.ledger(spark, folder)


@check(
    "s13_sql",
    a.using(a.NEWS) + "SELECT domain, max(facebook_interactions) AS best FROM news WHERE facebook_interactions >= 500 GROUP BY domain",
)
def ad_hoc_sql(spark, folder):
    return sql.query(
        spark,
        "SELECT domain, max(facebook_interactions) AS best FROM {news} WHERE facebook_interactions >= :least GROUP BY domain",
        {"news": a.news(spark, folder)},
        least=500,
    )


@check("s13_full_scan", a.using(a.NEWS) + "SELECT * FROM news")
def full_scan(spark, folder):
    return sql.full_scan(spark, a.news(spark, folder))


@check(
    "s14_base_training",
    a.using(a.ARTICLES)
    + "SELECT published, headline, article_theme || ' > ' || CASE WHEN article_theme = 'de' THEN '' ELSE article_index END AS label FROM arts",
)
def base_training(spark, folder):
    rows = a.articles(spark, folder).select(
        F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("Published"),
        F.col("headline").alias("Headline"),
        F.col("article_theme").alias("Theme"),
        F.when(F.col("article_theme") == "de", "-").otherwise(F.col("article_index")).alias("New Index"),
    )
    path = sinks.write_csv(rows, scratch_path(spark, "tagged"))
    return files.read_base_training(spark, path)


@check(
    "s15_prepare_snapshots",
    a.using(a.SNAPS)
    + """, firsts AS (
  SELECT link, published, facebook_interactions, date_extracted FROM snaps
  QUALIFY row_number() OVER (PARTITION BY link, date_extracted ORDER BY published, event_id) = 1)
SELECT s.event_id, s.link, s.published, s.facebook_interactions, f.date_extracted
FROM (SELECT event_id, link, published, facebook_interactions FROM snaps) s
LEFT JOIN firsts f ON s.link = f.link AND s.published = f.published
  AND s.facebook_interactions = f.facebook_interactions""",
)
def prepare_snapshots(spark, folder):
    snaps = a.snapshots(spark, folder)
    firsts = first_per_group(snaps, ["link", "date_extracted"], ["published", "event_id"])
    rows = snaps.select("event_id", "link", "published", "facebook_interactions")
    return attach_extraction_date(rows, firsts).select(
        "event_id", "link", "published", "facebook_interactions", "date_extracted"
    )
