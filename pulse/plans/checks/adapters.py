"""The supplied tables seen as articles, labels, snapshots, taxonomy and predictions.

Each frame has a twin in SQL under the same name, for use in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.domains import DOMAIN_GROUPS

# Two sites outside the publisher table, so that the lookup has misses.
SITES = [*DOMAIN_GROUPS, "example.com", "example.org"]
_SITES_SQL = "[" + ", ".join(f"'{s}'" for s in SITES) + "]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def news(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(F.lit("fb/"), "doc_id").alias("facebook_link"),
        F.concat(F.lit("doc/"), "doc_id").alias("link"),
        F.col("text").alias("headline"),
        F.concat("source", F.lit(": "), "text").alias("summary"),
        F.col("source").alias("domain"),
        F.col("lang").alias("facebook_page_name"),
        F.col("n_chars").alias("facebook_interactions"),
        F.concat(F.lit("scan_"), F.col("lang")).alias("source"),
        F.expr("timestampadd(MINUTE, doc_id * 37 % 43200, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("published"),
    )


NEWS = """news AS (
  SELECT 'fb/' || doc_id AS facebook_link, 'doc/' || doc_id AS link, text AS headline,
         source || ': ' || text AS summary, source AS domain, lang AS facebook_page_name,
         n_chars AS facebook_interactions, 'scan_' || lang AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37 % 43200) AS published
  FROM documents)"""


def labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return rows.select(
        F.concat(F.lit("fb/"), "doc_id").alias("facebook_link"),
        F.concat(F.lit("doc/"), "doc_id").alias("link"),
        F.array_compact(F.array("lang", F.when(F.col("toxic") == 1, "toxic"))).alias("themes"),
        F.array_compact(
            F.array(F.concat(F.lit("q"), "quality"), F.when(F.col("n_chars") > 2000, "long"))
        ).alias("indexes"),
        F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit("s"), F.col("doc_id") % 7)).alias("subindex"),
    )


LABELS = """labs AS (
  SELECT 'fb/' || l.doc_id AS facebook_link, 'doc/' || l.doc_id AS link,
         CASE WHEN l.toxic = 1 THEN [d.lang, 'toxic'] ELSE [d.lang] END AS themes,
         CASE WHEN d.n_chars > 2000 THEN ['q' || l.quality, 'long'] ELSE ['q' || l.quality] END AS indexes,
         CASE WHEN d.n_chars % 5 <> 0 THEN 's' || (d.doc_id % 7) END AS subindex
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    sites = F.array(*[F.lit(s) for s in SITES])
    return table(spark, folder, "events").select(
        "event_id",
        F.concat(F.lit("u/"), "user_id").alias("link"),
        F.col("ts").alias("published"),
        F.to_date("ts").alias("date"),
        F.to_date("ts").alias("date_extracted"),
        F.concat(F.lit("article "), "user_id").alias("headline"),
        F.concat(F.lit("seen by "), "user_id").alias("summary"),
        F.element_at(sites, (F.col("user_id") % len(SITES) + 1).cast("int")).alias("domain"),
        F.round(F.col("value") * 100).cast("long").alias("facebook_interactions"),
        F.col("event_type").alias("theme"),
        F.concat("event_type", F.lit("-"), F.col("user_id") % 4).alias("index"),
    )


SNAPS = f"""snaps AS (
  SELECT event_id, 'u/' || user_id AS link, ts AS published, CAST(ts AS DATE) AS date,
         CAST(ts AS DATE) AS date_extracted, 'article ' || user_id AS headline,
         'seen by ' || user_id AS summary, ({_SITES_SQL})[user_id % {len(SITES)} + 1] AS domain,
         CAST(round(value * 100) AS BIGINT) AS facebook_interactions,
         event_type AS theme, event_type || '-' || (user_id % 4) AS "index"
  FROM events)"""


def raw_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots as they are uploaded: labels still a list literal."""
    literal = F.concat(F.lit("['"), "theme", F.lit(" > "), "index", F.lit("', \"other's > x\"]"))
    return snapshots(spark, folder).withColumn("suggested_labels", literal).drop("theme", "index", "date")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with an index, for features."""
    sites = F.array(*[F.lit(s) for s in SITES])
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("doc/"), "doc_id").alias("link"),
        F.expr("timestampadd(MINUTE, doc_id * 37 % 43200, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("published"),
        F.expr("date_add(DATE'2024-01-01', cast(doc_id % 30 as int))").alias("date_extracted"),
        F.col("text").alias("headline"),
        F.concat("source", F.lit(": "), "text").alias("summary"),
        F.element_at(sites, (F.col("n_chars") % len(SITES) + 1).cast("int")).alias("domain"),
        F.col("n_chars").alias("facebook_interactions"),
        F.col("lang").alias("article_theme"),
        F.concat("lang", F.lit("-"), "source").alias("article_index"),
    )


ARTICLES = f"""arts AS (
  SELECT doc_id, 'doc/' || doc_id AS link,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37 % 43200) AS published,
         DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date_extracted, text AS headline,
         source || ': ' || text AS summary, ({_SITES_SQL})[n_chars % {len(SITES)} + 1] AS domain,
         n_chars AS facebook_interactions, lang AS article_theme, lang || '-' || source AS article_index
  FROM documents)"""


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_type").alias("theme"), F.concat("p_type", F.lit(" "), "p_name").alias("index")
    )


TAXONOMY = """taxo AS (SELECT p_partkey, p_type AS theme, p_type || ' ' || p_name AS "index" FROM part)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return rows.select(
        "doc_id",
        (F.col("quality") + F.col("toxic")).alias("label"),
        ((F.col("n_chars") > 2000).cast("int") + (F.col("lang") == "de").cast("int")).alias("pred_y"),
        F.concat("lang", F.lit("-"), F.col("source")).alias("article_index"),
        (F.col("n_chars") % 6).cast("double").alias("hours_since_published"),
    )


PREDS = """preds AS (
  SELECT l.doc_id, l.quality + l.toxic AS label,
         (CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END) + (CASE WHEN d.lang = 'de' THEN 1 ELSE 0 END) AS pred_y,
         d.lang || '-' || d.source AS article_index, CAST(d.n_chars % 6 AS DOUBLE) AS hours_since_published
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("vector"), (F.col("vec_id") * 7 % 101).alias("facebook_interactions")
    )


VECTORS = """vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vector, vec_id * 7 % 101 AS facebook_interactions
  FROM embeddings)"""


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the benchmark texts with scores by word length."""
    from pulse.functions.text import words

    listed = table(spark, folder, "benchmark").select(F.explode(words(F.lower("text"))).alias("word")).distinct()
    return listed.select(
        "word",
        ((F.length("word") % 5 - 2) / 2.0).alias("polarity"),
        ((F.length("word") % 3) / 2.0).alias("subjectivity"),
    )


def using(*parts: str) -> str:
    """WITH clause over some of the twins."""
    return "WITH " + ",\n".join(parts) + "\n"
