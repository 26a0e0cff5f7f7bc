"""Scalers, vectors, splits, models, whole jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulse.functions import text
from pulse.functions.domains import DOMAIN_GROUPS, GROUP_TRAFFIC
from pulse.operators import features, models, scaling, similarity

from pulse.operators.ordered import first_per_group
from pulse.plans import articles as jobs
from pulse.plans.checks import adapters as a
from pulse.plans.checks.expressions import _STOP, LEXICON, words_sql
from pulse.plans.checks.registry import check, joined, r6
from pulse.session import scratch_path, settle
from pulse.sources import sinks
from pulse.streaming import ingest


@check(
    "x01_scalers",
    a.using(a.SNAPS)
    + """, s AS (SELECT avg(facebook_interactions) AS m, stddev_pop(facebook_interactions) AS d, min(facebook_interactions) AS lo,
  max(facebook_interactions) AS hi, quantile_cont(facebook_interactions, 0.25) AS q1, quantile_cont(facebook_interactions, 0.5) AS q2,
  quantile_cont(facebook_interactions, 0.75) AS q3 FROM snaps)
SELECT event_id, round((facebook_interactions - m) / d, 6) AS s_scaled, round((facebook_interactions - lo) / (hi - lo), 6) AS mm_scaled,
  round((facebook_interactions - q2) / (q3 - q1), 6) AS r_scaled,
  round(ln(CASE WHEN facebook_interactions > 0 THEN facebook_interactions END), 6) AS log FROM snaps, s""",
)
def scalers(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "facebook_interactions")
    for kind, name in (("standard", "s_scaled"), ("minmax", "mm_scaled"), ("robust", "r_scaled"), ("log", "log")):
        rows = scaling.scale(rows, "facebook_interactions", kind, name)
    return rows.select("event_id", *[r6(c).alias(c) for c in ("s_scaled", "mm_scaled", "r_scaled", "log")])


@check(
    "x02_yeo_johnson",
    "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (power(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(power(1 - c_acctbal, 1.5) - 1) / 1.5 END, 6) AS value FROM customer",
)
def yeo_johnson(spark, folder):
    return a.table(spark, folder, "customer").select("c_custkey", r6(scaling.yeo_johnson("c_acctbal", 0.5)).alias("value"))


# The derivative of the likelihood is halved in on from both sides; its middle never hits 0 or 2, where the formulas have no value.
_MOVED = """CASE WHEN x >= 0 THEN (exp(p * u) - 1) / p ELSE -(exp((2 - p) * u) - 1) / (2 - p) END AS y,
  CASE WHEN x >= 0 THEN (exp(p * u) * (p * u - 1) + 1) / (p * p)
    ELSE (exp((2 - p) * u) * ((2 - p) * u - 1) + 1) / ((2 - p) * (2 - p)) END AS d"""


def power_sql(name: str, source: str, key: str, column: str) -> str:
    """Common tables ``name``: ``key`` and the standardised power transform of a column; needs WITH RECURSIVE."""
    return f"""{name}_x AS (SELECT {key}, CAST({column} AS DOUBLE) AS x, ln(1 + abs(CAST({column} AS DOUBLE))) AS u FROM {source}),
{name}_search AS (SELECT 0 AS i, CAST(-6.1 AS DOUBLE) AS lo, CAST(6.7 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN g > 0 THEN p ELSE lo END, CASE WHEN g > 0 THEN hi ELSE p END FROM (
    SELECT i, lo, hi, p, avg(sign(x) * u) - covar_pop(y, d) / var_pop(y) AS g
    FROM (SELECT i, lo, hi, p, x, u, {_MOVED} FROM (SELECT *, (lo + hi) / 2 AS p FROM {name}_search WHERE i < 50), {name}_x)
    GROUP BY i, lo, hi, p)),
{name}_moved AS (SELECT {key}, {_MOVED} FROM {name}_x, (SELECT (lo + hi) / 2 AS p FROM {name}_search WHERE i = 50)),
{name} AS (SELECT {key}, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS scaled FROM {name}_moved)"""


@check(
    "x02_power_transform",
    f"WITH RECURSIVE {power_sql('pt', 'customer', 'c_custkey', 'c_acctbal')} SELECT c_custkey, round(scaled, 3) AS scaled FROM pt",
)
def power_transform(spark, folder):
    rows = a.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    scaled = scaling.fit_power(rows, "c_acctbal").transform(rows, "scaled")
    return scaled.select("c_custkey", F.round("scaled", 3).alias("scaled"))


@check(
    "x03_quantile_transform",
    """WITH v AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS v, count(*) AS n, least(count(*), 1000) AS m FROM customer),
h AS (SELECT i, v, m, i * (n - 1) / (m - 1) AS h FROM (SELECT v, n, m, unnest(range(0, m)) AS i FROM v)),
marks AS (
  SELECT i, m, v[CAST(floor(h) AS BIGINT) + 1] + (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS mark
  FROM h),
spots AS (
  SELECT x, max(CASE WHEN mark <= x THEN i END) AS j, min(CASE WHEN mark >= x THEN i END) AS k
  FROM (SELECT DISTINCT c_acctbal AS x FROM customer), marks GROUP BY x),
placed AS (
  SELECT x, CASE WHEN j = a.m - 1 THEN 1 ELSE (j + (x - a.mark) / (b.mark - a.mark)) / (a.m - 1) END AS up,
         CASE WHEN k = 0 THEN 0 ELSE (k - (c.mark - x) / (c.mark - d.mark)) / (a.m - 1) END AS down
  FROM spots JOIN marks a ON a.i = j LEFT JOIN marks b ON b.i = j + 1 JOIN marks c ON c.i = k LEFT JOIN marks d ON d.i = k - 1)
SELECT c_custkey, round((up + down) / 2, 6) AS scaled FROM customer JOIN placed ON c_acctbal = x""",
)
def quantile_transform(spark, folder):
    rows = a.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    scaled = scaling.fit_quantiles(rows, "c_acctbal").transform(rows, "scaled")
    return scaled.select("c_custkey", r6("scaled").alias("scaled"))


@check(
    "x04_minmax_of_train",
    a.using(a.ARTICLES)
    + """, s AS (SELECT min(facebook_interactions) AS lo, max(facebook_interactions) AS hi FROM arts WHERE article_theme = 'en')
SELECT doc_id, round((facebook_interactions - lo) / (hi - lo), 6) AS facebook_interactions FROM arts, s""",
)
def minmax_of_train(spark, folder):
    rows = a.articles(spark, folder).select("doc_id", "article_theme", "facebook_interactions")
    model = scaling.MinMaxModel.fit(rows.where("article_theme = 'en'"), ["facebook_interactions"])
    return model.transform(rows).select("doc_id", r6("facebook_interactions").alias("facebook_interactions"))


#: The encoder's own width, and every numeric feature of an article.
_WIDTH = 1024
_NUMERIC = ["facebook_interactions", "hours_since_published", "day_of_week_published", "hour_of_day_published"]
_NUMERIC += [f"{c}_{k}word_count" for c in features.TEXTS for k in ("", "non_stop_", "unique_")]
_NUMERIC += [f"{c}_{k}" for c in features.TEXTS for k in ("sentiment", "subjectivity")]


def _embedded(spark, folder):
    rows = a.articles(spark, folder).select("doc_id", "headline", "article_theme", "facebook_interactions")
    encoder = models.HashingEncoder.fit(rows, "headline", _WIDTH)
    return models.embed(rows, "headline", encoder)


@check("x05_embed")
def embed(spark, folder):
    rows = models.as_array(_embedded(spark, folder))
    return rows.select("doc_id", joined(F.transform("vector", lambda x: F.round(x, 4).cast("string"))).alias("vector"))


@check("x06_suggest_labels")
def suggest_labels(spark, folder):
    rows = _embedded(spark, folder).join(
        a.labels(spark, folder).select(F.regexp_extract("link", r"\d+", 0).cast("long").alias("doc_id"), "themes", "indexes"),
        "doc_id",
        "left",
    )
    rows = settle(rows.select("doc_id", "vector", "themes", "indexes"))
    for kind, output in (("themes", "suggested"), ("indexes", "suggested_indexes")):
        known = rows.where(F.col(kind).isNotNull())
        names = known.select(F.explode(kind).alias("name")).distinct().orderBy("name").collect()
        model = models.LabelSuggester.fit(known, kind, [r.name for r in names])
        rows = models.suggest_labels(rows, model, output)
    return rows.select("doc_id", joined("suggested").alias("suggested"), joined("suggested_indexes").alias("suggested_indexes"))


@check("x07_train_labels")
def train_labels(spark, folder):
    rows = settle(_embedded(spark, folder).select("doc_id", "vector", F.col("article_theme").alias("label")))
    split = models.stratified_split(rows, "label", "doc_id")
    model = models.train_labels(split.where("split = 'train'"))
    ranked = models.ranked_labels(split.where("split = 'test'"), model)
    return ranked.select("doc_id", "label", joined("suggested_labels").alias("suggested_labels"))


@check(
    "x08_similarity_to_seed",
    a.using(a.VECTORS)
    + """, seed AS (SELECT vector AS s FROM vecs ORDER BY facebook_interactions DESC, vec_id LIMIT 1)
SELECT vec_id, row_number() OVER (ORDER BY list_cosine_similarity(vector, s) DESC, vec_id) - 1 AS similarity_rank FROM vecs, seed""",
)
def similarity_to_seed(spark, folder):
    rows = a.vectors(spark, folder)
    seed = similarity.top_article(rows, "vec_id")
    return similarity.similarity_to_seed(rows, seed, "vec_id").select("vec_id", "similarity_rank")


@check("x08_similarity_chain")
def similarity_chain(spark, folder):
    return similarity.similarity_chain(a.vectors(spark, folder), "label", "vec_id")


@check("x09_stratified_split")
def stratified_split(spark, folder):
    rows = a.articles(spark, folder).select("doc_id", "article_theme")
    return models.stratified_split(rows, "article_theme", "doc_id", 0.2, 0.2)


@check(
    "x09_split_sizes",
    a.using(a.ARTICLES)
    + """, n AS (SELECT article_index, count(*) AS n, round(count(*) * 0.2) AS t FROM arts GROUP BY 1),
s AS (SELECT article_index, n, t, round((n - t) * 0.2) AS v FROM n)
SELECT article_index, split, CAST(c AS BIGINT) AS "count" FROM (
  SELECT article_index, unnest(['test', 'validation', 'train']) AS split, unnest([t, v, n - t - v]) AS c FROM s) WHERE c > 0""",
)
def split_sizes(spark, folder):
    rows = a.articles(spark, folder).select("doc_id", "article_index")
    split = models.stratified_split(rows, "article_index", "doc_id", 0.2, 0.2)
    return split.groupBy("article_index", "split").count()


_SHEET = """sheet AS (
  SELECT p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN p_type END AS theme, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS idx FROM part)"""
_TAXONOMY = _SHEET + """,
cells AS (SELECT * FROM sheet WHERE pos < (SELECT max(pos) FROM sheet) AND (theme IS NOT NULL OR idx IS NOT NULL)),
filled AS (SELECT last_value(theme IGNORE NULLS) OVER w AS theme, last_value(idx IGNORE NULLS) OVER w AS idx FROM cells
  WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
names AS (SELECT DISTINCT coalesce(theme, '') || ' > ' || coalesce(idx, '') AS label FROM filled)"""


def _taxonomy(spark, folder):
    sheet = a.table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("theme"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("index"),
    )
    return models.taxonomy_labels(sheet, "pos")


@check(
    "x11_create_dataset",
    f"""WITH {_TAXONOMY}, {a.ARTICLES},
base AS (SELECT DATE '2024-01-01' + CAST(l_linenumber AS INTEGER) AS published, l_returnflag AS headline,
  p_type || ' > ' || p_brand AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
made AS (SELECT published, headline, article_theme || ' > ' || article_index AS label FROM arts),
rows AS (SELECT * FROM base UNION ALL SELECT * FROM made)
SELECT published, headline, label FROM rows WHERE label IN (SELECT label FROM names)
  AND label IN (SELECT label FROM rows GROUP BY label HAVING count(*) >= 10)""",
)
def create_dataset(spark, folder):
    base = a.table(spark, folder, "lineitem").join(a.table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
    base = base.select(
        F.expr("date_add(DATE'2024-01-01', l_linenumber)").cast("timestamp_ntz").alias("published"),
        F.col("l_returnflag").alias("headline"),
        text.join_label(F.col("p_type"), F.col("p_brand")).alias("label"),
    )
    made = a.articles(spark, folder).select(
        "published", "headline", text.join_label(F.col("article_theme"), F.col("article_index")).alias("label")
    )
    return models.create_dataset(made, base, _taxonomy(spark, folder), 10)


@check("x12_taxonomy_labels", f"WITH {_TAXONOMY} SELECT label FROM names")
def taxonomy_labels(spark, folder):
    return _taxonomy(spark, folder)


@check("x13_fusion_classifier")
def fusion_classifier(spark, folder):
    known = a.predictions(spark, folder).select("doc_id", "label")
    made = jobs.engineer_features(a.articles(spark, folder), "doc_id", a.lexicon(spark, folder), ["doc_id"])
    made = made.select("doc_id", *[F.col(c).cast("double").alias(c) for c in _NUMERIC])
    rows = _embedded(spark, folder).drop(*_NUMERIC).join(known, "doc_id").join(made, "doc_id")
    rows = settle(rows.select("doc_id", "label", "vector", *_NUMERIC))
    split = models.stratified_split(rows, "label", "doc_id", 0.2, 0.2)
    scaled = scaling.MinMaxModel.fit(split.where("split = 'train'"), _NUMERIC).transform(split)
    model = models.fusion_classifier(scaled.where("split = 'train'"), _NUMERIC)
    return model.transform(scaled.where("split = 'test'")).select("doc_id", "label", "pred_y")


_COUNTS = ", ".join(
    f"CAST(len({words_sql(c)}) AS INTEGER) AS {c}_word_count, "
    f"CAST(len(list_filter({words_sql(f'lower({c})')}, lambda w: w NOT IN ({_STOP}))) AS INTEGER) AS {c}_non_stop_word_count, "
    f"CAST(len(list_distinct({words_sql(c)})) AS INTEGER) AS {c}_unique_word_count"
    for c in features.TEXTS
)


@check(
    "x15_engineer_features",
    a.using(a.ARTICLES)
    + f""", joined AS (SELECT *, headline || ' ' || summary AS text,
  coalesce((epoch_us(published) - lag(epoch_us(published)) OVER (PARTITION BY article_index ORDER BY published, doc_id)) / 3.6e9, 0) AS h FROM arts)
SELECT doc_id, round(h, 6) AS hours_since_published, CAST(isodow(published) AS INTEGER) AS day_of_week_published,
  CAST(hour(published) AS INTEGER) AS hour_of_day_published, {_COUNTS} FROM joined""",
)
def engineer_features(spark, folder):
    rows = jobs.engineer_features(a.articles(spark, folder), "doc_id", ties=["doc_id"])
    counts = [f"{c}_{k}word_count" for c in features.TEXTS for k in ("", "non_stop_", "unique_")]
    return rows.select(
        "doc_id",
        r6("hours_since_published").alias("hours_since_published"),
        "day_of_week_published",
        "hour_of_day_published",
        *counts,
    )


_SCORES = ", ".join(
    f"round(coalesce(sum(CASE WHEN part IN ({parts}) THEN {score} END) / count(CASE WHEN part IN ({parts}) THEN 1 END), 0), 6) AS {c}_{name}"
    for c, parts in (("headline", "'h'"), ("summary", "'s'"), ("text", "'h', 's'"))
    for name, score in (("sentiment", "polarity"), ("subjectivity", "subjectivity"))
)


@check(
    "x15_lexicon_features",
    a.using(a.ARTICLES, LEXICON)
    + f""", tokens AS (
  SELECT doc_id, 'h' AS part, unnest({words_sql('lower(headline)')}) AS word FROM arts
  UNION ALL SELECT doc_id, 's', unnest({words_sql('lower(summary)')}) FROM arts),
hits AS (SELECT doc_id, part, polarity, subjectivity FROM tokens JOIN lex ON tokens.word = lex.word)
SELECT arts.doc_id, {_SCORES} FROM arts LEFT JOIN hits ON arts.doc_id = hits.doc_id GROUP BY arts.doc_id""",
)
def lexicon_features(spark, folder):
    rows = jobs.engineer_features(a.articles(spark, folder), "doc_id", a.lexicon(spark, folder), ["doc_id"])
    scores = [f"{c}_{k}" for c in features.TEXTS for k in ("sentiment", "subjectivity")]
    return rows.select("doc_id", *[r6(c).alias(c) for c in scores])


_GROUP_SQL = ", ".join(f"('{d}', '{g}', {v}, {u})" for d, g in DOMAIN_GROUPS.items() for v, u in [GROUP_TRAFFIC[g]])


@check(
    "x15_prepare_articles",
    a.using(a.ARTICLES)
    + f""", firsts AS (SELECT * FROM arts QUALIFY row_number() OVER (PARTITION BY headline, published ORDER BY date_extracted, doc_id) = 1),
uniq AS (SELECT * FROM firsts QUALIFY count(*) OVER (PARTITION BY article_index) > 1),
timed AS (SELECT *, coalesce((epoch_us(published) - lag(epoch_us(published)) OVER (PARTITION BY article_index ORDER BY published, doc_id)) / 3.6e9, 0) AS h FROM uniq),
traffic(domain, domain_group, visits, visitors) AS (VALUES {_GROUP_SQL})
SELECT doc_id, round(h, 6) AS hours_since_published, domain_group, CAST(visits AS BIGINT) AS mean_monthly_visits
FROM timed JOIN traffic ON timed.domain = traffic.domain""",
)
def prepare_articles(spark, folder):
    rows = jobs.prepare_articles(a.articles(spark, folder), "doc_id", ties=["doc_id"])
    return rows.select(
        "doc_id", r6("hours_since_published").alias("hours_since_published"), "domain_group", "mean_monthly_visits"
    )


@check(
    "x16_label_articles",
    f"""WITH RECURSIVE {a.SNAPS}, seen AS (
  SELECT link, facebook_interactions AS v,
    row_number() OVER (PARTITION BY link ORDER BY headline DESC, published, date_extracted, event_id) AS n FROM snaps),
merged AS (SELECT link, avg(v) AS mean, greatest(coalesce(regr_slope(v, n), 0), 0) AS gradient FROM seen GROUP BY link),
{power_sql('slope', 'merged', 'link', 'gradient')},
{power_sql('level', 'merged', 'link', 'mean')}
SELECT link, round(mean, 6) AS mean, round(gradient, 6) AS gradient,
  CAST(CASE WHEN slope.scaled > 1 OR level.scaled > 1 THEN 2 WHEN slope.scaled < -1 OR level.scaled < -1 THEN 0 ELSE 1 END AS INTEGER) AS label
FROM merged JOIN slope USING (link) JOIN level USING (link)""",
)
def label_articles(spark, folder):
    rows = a.snapshots(spark, folder)
    unique = first_per_group(rows, ["link"], ["published", "event_id"])
    labelled = features.label_codes(jobs.label_articles(unique, rows, ["event_id"]))
    return labelled.select("link", r6("mean").alias("mean"), r6("gradient").alias("gradient"), "label")


@check(
    "x18_process_snapshots",
    a.using(a.SNAPS)
    + """, lagged AS (
  SELECT *, lag(facebook_interactions) OVER (PARTITION BY link ORDER BY headline DESC, published, date_extracted, event_id) AS b FROM snaps)
SELECT event_id, published, date, strftime(published, '%H:%M:%S') AS time, date_extracted, headline, summary, link, domain,
  facebook_interactions, coalesce(facebook_interactions - b, 0) AS facebook_interactions_abs_change,
  coalesce(facebook_interactions / nullif(b, 0) - 1, 0) AS facebook_interactions_pct_change, theme, "index" FROM lagged""",
)
def process_snapshots(spark, folder):
    return jobs.process_snapshots(a.raw_snapshots(spark, folder), ["event_id"])


@check(
    "w11_seed_order",
    a.using(a.VECTORS)
    + """, seed AS (SELECT vector AS s FROM vecs ORDER BY facebook_interactions DESC, vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(vector, s), 6) AS similarity,
  row_number() OVER (ORDER BY list_cosine_similarity(vector, s) DESC, vec_id) - 1 AS similarity_rank FROM vecs, seed""",
)
def seed_order(spark, folder):
    rows = a.vectors(spark, folder)
    ranked = similarity.similarity_to_seed(rows, similarity.top_article(rows, "vec_id"), "vec_id")
    return ranked.select("vec_id", r6("similarity").alias("similarity"), "similarity_rank")


@check(
    "z01_ingest_scans",
    a.using(a.NEWS)
    + """SELECT facebook_link, published + INTERVAL 8 HOUR AS published, facebook_interactions FROM news""",
)
def ingest_scans(spark, folder):
    """Every article arrives twice, the second time with more or as many interactions kept."""
    from pulse.plans.checks.files import _scan

    landing, store, progress = (scratch_path(spark, n) for n in ("landing", "store", "progress"))
    rows = _scan(a.news(spark, folder))
    sinks.write_csv(rows.withColumn("Total Interactions", F.col("Total Interactions") - 5), landing, compression="gzip")
    ingest.ingest_scans(spark, landing, store, progress).awaitTermination()
    sinks.write_csv(rows, landing, mode="append", compression="gzip")
    ingest.ingest_scans(spark, landing, store, progress).awaitTermination()
    return ingest.stored_table(spark, store).select("facebook_link", "published", "facebook_interactions")


@check(
    "z02_daily_theme_totals",
    a.using(a.SNAPS)
    + """SELECT date AS day, theme, CAST(sum(facebook_interactions) AS BIGINT) AS facebook_interactions, count(*) AS "count"
FROM snaps GROUP BY 1, 2""",
)
def daily_theme_totals(spark, folder):
    path, progress = scratch_path(spark, "totals"), scratch_path(spark, "progress")
    query = (
        ingest.daily_theme_totals(_event_stream(spark, folder), None)
        .writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path) and None)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def _event_stream(spark, folder):
    """Events as they would arrive, whether the table is one file or a folder of files."""
    # A pattern, as a plain path must be a folder.
    stream = spark.readStream.schema(a.table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]")
    return stream.select(
        F.col("ts").alias("published"),
        F.col("event_type").alias("theme"),
        F.round(F.col("value") * 100).cast("long").alias("facebook_interactions"),
    )


@check(
    "z02_closed_days",
    a.using(a.SNAPS)
    + """SELECT date AS day, theme, CAST(sum(facebook_interactions) AS BIGINT) AS facebook_interactions, count(*) AS "count"
FROM snaps WHERE date + INTERVAL 1 DAY <= (SELECT max(published) - INTERVAL 1 DAY FROM snaps) GROUP BY 1, 2""",
)
def closed_days(spark, folder):
    """Days that ended at least one day before the newest row, each written once by the stream."""
    path, progress = scratch_path(spark, "closed"), scratch_path(spark, "progress")
    ingest.append_closed_days(_event_stream(spark, folder), path, progress).awaitTermination()
    return spark.read.parquet(path)
