"""Projections, filters, joins, set operations and sorts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulse.functions import values
from pulse.functions.domains import DOMAIN_GROUPS
from pulse.functions.domains import GROUP_TRAFFIC
from pulse.operators import articles as art
from pulse.operators import evaluate, features, labelling, mutate, ranking, snapshots
from pulse.operators.ordered import first_per_group, order_by
from pulse.plans.checks import adapters as a
from pulse.plans.checks.registry import check, joined, r6
from pulse.sources import files

_FROM, _TO = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 25, 23, 59)
_WITHOUT = ["src0", "src7"]
_FILTER = """domain NOT IN ('src0', 'src7') AND facebook_interactions >= 500
  AND published BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25 23:59:00' AND headline IS NOT NULL"""


def selected(spark, folder, sort=False):
    """The filtered article list most queries start from."""
    return art.filter_articles(
        a.news(spark, folder), a.labels(spark, folder), _WITHOUT, 500, (_FROM, _TO), sort=sort
    )


SELECTED = f"""{a.NEWS},
{a.LABELS},
sel AS (
  SELECT n.*, coalesce(l.themes, []) AS themes, coalesce(l.indexes, []) AS indexes, l.subindex
  FROM news n LEFT JOIN labs l ON n.facebook_link = l.facebook_link WHERE {_FILTER})"""


@check("p01_sanitise_columns", 'SELECT doc_id AS "doc_id", source AS "facebook_page_name" FROM documents')
def sanitise_columns(spark, folder):
    rows = a.table(spark, folder, "documents")
    return files.sanitise_columns(rows.select(F.col("doc_id").alias("Doc ID"), F.col("source").alias("Facebook Page Name")))


@check("p02_strict_cast", "SELECT doc_id, CAST(CAST(n_chars AS VARCHAR) AS BIGINT) AS n FROM documents")
def strict_cast(spark, folder):
    rows = a.table(spark, folder, "documents").select(
        "doc_id", F.col("n_chars").cast("string").alias("Facebook Interactions")
    )
    good, _ = files.split_malformed_counts(rows)
    return good.select("doc_id", F.col("Facebook Interactions").cast("long").alias("n"))


@check(
    "p03_null_defaults",
    a.using(a.NEWS, a.LABELS)
    + """SELECT n.facebook_link, coalesce(l.subindex, '') AS subindex, array_to_string(coalesce(l.themes, []), '|') AS themes,
  array_to_string(list_concat(coalesce(l.themes, []), coalesce(l.indexes, [])), '|') AS themes_indexes
FROM news n LEFT JOIN labs l ON n.facebook_link = l.facebook_link""",
)
def null_defaults(spark, folder):
    rows = art.filled_lists(art.with_labels(a.news(spark, folder), a.labels(spark, folder)))
    return rows.na.fill("", ["subindex"]).select(
        "facebook_link", "subindex", joined("themes").alias("themes"), joined("themes_indexes").alias("themes_indexes")
    )


@check("p04_drop_nulls", a.using(a.LABELS) + "SELECT facebook_link, subindex FROM labs WHERE subindex IS NOT NULL")
def drop_nulls(spark, folder):
    return a.labels(spark, folder).dropna("any", subset=["subindex"]).select("facebook_link", "subindex")


@check(
    "p05_filter_articles",
    "WITH " + SELECTED + "SELECT facebook_link, link, published, domain, facebook_interactions, headline, subindex FROM sel",
)
def filter_articles(spark, folder):
    return selected(spark, folder, sort=True).select(
        "facebook_link", "link", "published", "domain", "facebook_interactions", "headline", "subindex"
    )


@check(
    "p06_labelled_articles",
    a.using(a.NEWS, a.LABELS)
    + """SELECT n.facebook_link, n.published, array_to_string(l.themes, '|') AS themes, l.subindex
FROM news n LEFT JOIN labs l ON n.facebook_link = l.facebook_link
WHERE len(l.themes) > 0 OR len(l.indexes) > 0 OR l.subindex IS NOT NULL""",
)
def labelled_articles(spark, folder):
    rows = art.labelled_articles(a.news(spark, folder), a.labels(spark, folder))
    return rows.select("facebook_link", "published", joined("themes").alias("themes"), "subindex")


@check(
    "p07_filter_snapshots",
    a.using(a.SNAPS)
    + """SELECT event_id, link, theme, "index", facebook_interactions FROM snaps
WHERE facebook_interactions >= 500 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND theme NOT IN ('error') AND "index" NOT IN ('click-1')""",
)
def filter_snapshots(spark, folder):
    rows = snapshots.filter_snapshots(
        a.snapshots(spark, folder), 500, (dt.date(2024, 1, 5), dt.date(2024, 1, 20)), ["error"], ["click-1"]
    )
    return rows.select("event_id", "link", "theme", "index", "facebook_interactions")


@check("p08_only", a.using(a.SNAPS) + "SELECT event_id, theme FROM snaps WHERE theme IN ('click', 'view')")
def only(spark, folder):
    return snapshots.only(a.snapshots(spark, folder), "theme", ["click", "view"]).select("event_id", "theme")


@check(
    "p09_explore",
    a.using(a.SNAPS)
    + """SELECT event_id, theme, published, facebook_interactions FROM snaps
WHERE theme IN ('click', 'error') AND facebook_interactions BETWEEN 100 AND 5000
  AND published >= TIMESTAMP '2024-01-10' AND regexp_matches(headline, '1$')""",
)
def explore(spark, folder):
    rows = art.explore(
        a.snapshots(spark, folder),
        {
            "theme": ["click", "error"],
            "facebook_interactions": (100, 5000),
            "published": (dt.datetime(2024, 1, 10), None),
            "headline": "1$",
        },
    )
    return rows.select("event_id", "theme", "published", "facebook_interactions")


@check(
    "p10_threshold_sample",
    a.using(a.SNAPS)
    + """SELECT event_id, headline, facebook_interactions FROM snaps WHERE facebook_interactions > 3000
ORDER BY headline DESC, published, event_id LIMIT 15""",
)
def threshold_sample(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "headline", "published", "facebook_interactions")
    sample = ranking.threshold_sample(rows, "facebook_interactions", 3000, ["-headline", "published", "event_id"])
    return sample.select("event_id", "headline", "facebook_interactions")


_SCALED = """, z AS (
  SELECT event_id, (facebook_interactions - avg(facebook_interactions) OVER ()) / stddev_pop(facebook_interactions) OVER () AS a,
         (event_id - avg(event_id) OVER ()) / stddev_pop(event_id) OVER () AS b FROM snaps)"""


@check(
    "p11_traction_label",
    a.using(a.SNAPS) + _SCALED + """
SELECT event_id, CASE WHEN a > 1 OR b > 1 THEN 'trending' WHEN a < -1 OR b < -1 THEN 'diminishing'
                      ELSE 'neutral' END AS label FROM z""",
)
def traction_label(spark, folder):
    from pulse.operators.scaling import fit_scaler

    rows = a.snapshots(spark, folder)
    first, second = (fit_scaler(rows, c, "standard").expression() for c in ("facebook_interactions", "event_id"))
    return rows.select("event_id", labelling.traction_label(first, second).alias("label"))


@check(
    "p12_bin4",
    a.using(a.SNAPS)
    + """SELECT event_id, CASE WHEN facebook_interactions / top < 0.25 THEN 'lowest' WHEN facebook_interactions / top < 0.5 THEN 'low'
  WHEN facebook_interactions / top < 0.75 THEN 'moderate' ELSE 'high' END AS bin
FROM (SELECT event_id, facebook_interactions, max(facebook_interactions) OVER () AS top FROM snaps)""",
)
def bin4(spark, folder):
    rows = features.ratio_to_max(a.snapshots(spark, folder), ["facebook_interactions"])
    return rows.select("event_id", values.bin4("facebook_interactions", (0.25, 0.5, 0.75)).alias("bin"))


@check("p13_clip_negative", "SELECT c_custkey, greatest(c_acctbal, 0) AS balance FROM customer")
def clip_negative(spark, folder):
    return a.table(spark, folder, "customer").select("c_custkey", values.clip_negative("c_acctbal").alias("balance"))


_CODE_SQL = a.using(a.PREDS) + """
SELECT doc_id, label AS label_code, CAST(CASE WHEN dayofweek(DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER)) = 0 THEN 7
  ELSE dayofweek(DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER)) END AS INTEGER) AS day FROM preds"""


@check("p14_value_mapping", _CODE_SQL)
def value_mapping(spark, folder):
    rows = a.predictions(spark, folder)
    names = {0: "diminishing", 1: "neutral", 2: "trending"}
    named = rows.withColumn("label_code", values.lookup("label", names))
    coded = features.label_codes(named, "label_code")
    day = F.date_format(F.expr("date_add(DATE'2024-01-01', cast(doc_id % 7 as int))"), "EEEE")
    weekdays = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4, "Friday": 5, "Saturday": 6, "Sunday": 7}
    return coded.select("doc_id", "label_code", values.lookup(day, weekdays).alias("day"))


@check(
    "p15_one_hot",
    a.using(a.SNAPS)
    + "SELECT event_id, " + ", ".join(
        f"CAST(theme = '{t}' AS INTEGER) AS theme_{t}" for t in ("click", "error", "purchase", "signup", "view")
    ) + " FROM snaps",
)
def one_hot(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "theme")
    return features.one_hot(rows, "theme", ["click", "error", "purchase", "signup", "view"])


_PRIORITIES = ["toxic", "long", "de"]
_TOPIC = """CASE WHEN list_contains(list_concat(themes, indexes), 'toxic') THEN 'toxic'
  WHEN list_contains(list_concat(themes, indexes), 'long') THEN 'long'
  WHEN list_contains(list_concat(themes, indexes), 'de') THEN 'de' ELSE subindex END"""


@check("p16_main_topic", "WITH " + SELECTED + f"SELECT facebook_link, {_TOPIC} AS main_topic FROM sel")
def main_topic(spark, folder):
    rows = art.filled_lists(selected(spark, folder))
    return art.with_main_topic(rows, _PRIORITIES).select("facebook_link", "main_topic")


@check(
    "p17_assign_group_labels",
    "WITH " + SELECTED + """, chosen AS (
  SELECT subindex, array_agg(DISTINCT facebook_page_name ORDER BY facebook_page_name) AS themes
  FROM sel WHERE subindex IS NOT NULL GROUP BY subindex)
SELECT s.facebook_link, s.subindex, array_to_string(c.themes, '|') AS themes
FROM sel s LEFT JOIN chosen c ON s.subindex = c.subindex WHERE length(s.subindex) > 0""",
)
def assign_group_labels(spark, folder):
    rows = selected(spark, folder)
    chosen = (
        rows.where(F.col("subindex").isNotNull())
        .groupBy("subindex")
        .agg(F.array_sort(F.collect_set("facebook_page_name")).alias("themes"))
        .withColumn("indexes", F.array().cast("array<string>"))
    )
    done = art.assign_group_labels(rows, chosen)
    return done.select("facebook_link", "subindex", joined("themes").alias("themes"))


@check("p18_drop_last", a.using(a.TAXONOMY) + 'SELECT p_partkey, theme, "index" FROM taxo WHERE p_partkey < (SELECT max(p_partkey) FROM taxo)')
def drop_last(spark, folder):
    return ranking.drop_last(a.taxonomy(spark, folder), "p_partkey")


@check("p19_drop_columns", a.using(a.SNAPS) + "SELECT event_id, link, theme FROM snaps")
def drop_columns(spark, folder):
    return a.snapshots(spark, folder).drop(
        "published", "date", "date_extracted", "headline", "summary", "domain", "facebook_interactions", "index"
    )


@check(
    "j01_with_labels",
    a.using(a.NEWS, a.LABELS)
    + """SELECT n.facebook_link, n.link, l.subindex, array_to_string(l.indexes, '|') AS indexes
FROM news n LEFT JOIN labs l ON n.facebook_link = l.facebook_link""",
)
def with_labels(spark, folder):
    rows = art.with_labels(a.news(spark, folder), a.labels(spark, folder))
    return rows.select("facebook_link", "link", "subindex", joined("indexes").alias("indexes"))


@check(
    "j02_attach_extraction_date",
    a.using(a.SNAPS)
    + """, known AS (SELECT * FROM snaps WHERE theme = 'click')
SELECT s.event_id, k.date_extracted FROM snaps s LEFT JOIN known k ON s.published IS NOT DISTINCT FROM k.published
  AND s.link IS NOT DISTINCT FROM k.link AND s.facebook_interactions IS NOT DISTINCT FROM k.facebook_interactions""",
)
def attach_extraction_date(spark, folder):
    rows = a.snapshots(spark, folder)
    known = snapshots.only(rows, "theme", ["click"])
    return snapshots.attach_extraction_date(rows.drop("date_extracted"), known).select("event_id", "date_extracted")


_GRADIENT = """, seen AS (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY headline DESC, published, date_extracted, event_id) - 1 AS x FROM snaps),
grads AS (
  SELECT link, avg(facebook_interactions) AS mean,
         CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(facebook_interactions, x) END AS gradient FROM seen GROUP BY link),
uniq AS (
  SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY link ORDER BY published, event_id) = 1)"""


@check(
    "j03_merge_gradients",
    a.using(a.SNAPS) + _GRADIENT + """
SELECT u.event_id, u.link, u.facebook_interactions, round(g.mean, 6) AS mean, round(greatest(g.gradient, 0), 6) AS gradient
FROM uniq u LEFT JOIN grads g ON u.link = g.link""",
)
def merge_gradients(spark, folder):
    rows = a.snapshots(spark, folder)
    unique = first_per_group(rows, ["link"], ["published", "event_id"])
    merged = labelling.merge_gradients(unique, labelling.article_gradient(rows, ["event_id"]))
    return merged.select(
        "event_id", "link", "facebook_interactions", r6("mean").alias("mean"), r6("gradient").alias("gradient")
    )


@check(
    "j04_merge_labels",
    a.using(a.SNAPS)
    + """, marks AS (SELECT link, CAST(count(*) % 3 AS INTEGER) AS label FROM snaps WHERE theme = 'click' GROUP BY link)
SELECT s.event_id, m.label FROM snaps s LEFT JOIN marks m ON s.link = m.link""",
)
def merge_labels(spark, folder):
    rows = a.snapshots(spark, folder)
    marks = rows.where("theme = 'click'").groupBy("link").agg((F.count("*") % 3).cast("int").alias("label"))
    return labelling.merge_labels(rows, marks).select("event_id", "label")


_GROUPS_SQL = ", ".join(f"('{d}', '{g}')" for d, g in DOMAIN_GROUPS.items())
_TRAFFIC_SQL = ", ".join(f"('{g}', {v}, {u})" for g, (v, u) in GROUP_TRAFFIC.items())


@check(
    "j05_domain_traffic",
    a.using(a.SNAPS)
    + f""", groups(domain, domain_group) AS (VALUES {_GROUPS_SQL}),
traffic(domain_group, visits, visitors) AS (VALUES {_TRAFFIC_SQL})
SELECT s.event_id, s.domain, g.domain_group, CAST(t.visits AS BIGINT) AS mean_monthly_visits,
       CAST(t.visitors AS BIGINT) AS mean_monthly_unique_visitors
FROM snaps s LEFT JOIN groups g ON s.domain = g.domain LEFT JOIN traffic t ON g.domain_group = t.domain_group""",
)
def domain_traffic(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "domain")
    return features.with_traffic(rows)


@check(
    "j06_known_domains",
    a.using(a.SNAPS) + "SELECT event_id, domain FROM snaps WHERE domain NOT IN ('example.com', 'example.org')",
)
def known_domains(spark, folder):
    return features.keep_known_domains(a.snapshots(spark, folder)).select("event_id", "domain")


_GROUPS = "WITH " + SELECTED + """, pairs AS (
  SELECT DISTINCT subindex, label FROM (SELECT subindex, unnest(themes) AS label FROM sel) WHERE length(subindex) > 0)
SELECT subindex, CAST(1 AS BIGINT) AS page, string_agg(label, '|' ORDER BY label) AS labels FROM pairs """


@check("j06_labels_in_taxonomy", _GROUPS + "WHERE label IN (SELECT lang FROM documents WHERE n_chars > 10000) GROUP BY subindex")
def labels_in_taxonomy(spark, folder):
    allowed = a.table(spark, folder, "documents").where("n_chars > 10000").select("lang").distinct()
    rows = art.group_label_lists(selected(spark, folder), "themes", allowed)
    return rows.withColumn("labels", joined("labels"))


@check("f18_group_label_lists", _GROUPS + "GROUP BY subindex")
def group_label_lists(spark, folder):
    return art.group_label_lists(selected(spark, folder), "themes").withColumn("labels", joined("labels"))


@check(
    "j07_new_files",
    "SELECT DISTINCT source AS filename FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars > 3000)",
)
def new_files(spark, folder):
    rows = a.table(spark, folder, "documents").withColumnRenamed("source", "filename")
    loaded = rows.where("lang = 'de' and n_chars > 3000")
    return files.new_files(rows.select("filename").distinct(), loaded)


@check(
    "j08_over_threshold",
    a.using(a.SNAPS)
    + """, hot AS (
  SELECT theme, date_extracted, avg(facebook_interactions) AS m FROM snaps GROUP BY ALL HAVING m >= 2500)
SELECT published, headline, theme, facebook_interactions, link FROM snaps
WHERE theme IN (SELECT theme FROM hot) AND date_extracted IN (SELECT date_extracted FROM hot)
QUALIFY row_number() OVER (PARTITION BY published, headline, theme ORDER BY date_extracted, link) = 1""",
)
def over_threshold(spark, folder):
    rows = a.snapshots(spark, folder)
    totals = snapshots.aggregate_change(rows, "theme", "mean")
    return snapshots.articles_over_threshold(rows, totals, "theme", "facebook_interactions", 2500)


@check(
    "j09_update_from",
    a.using(a.LABELS)
    + """SELECT facebook_link, CASE WHEN list_contains(indexes, 'long') THEN nullif('new-' || facebook_link, 'new-fb/1')
  ELSE subindex END AS subindex FROM labs""",
)
def update_from(spark, folder):
    rows = a.labels(spark, folder)
    batch = rows.where(F.array_contains("indexes", "long")).select(
        "facebook_link", F.nullif(F.concat(F.lit("new-"), "facebook_link"), F.lit("new-fb/1")).alias("subindex")
    )
    return mutate.update_from(rows, batch).select("facebook_link", "subindex")


_EVAL = """
SELECT round(sum(hits) / sum(actual), 3) AS accuracy, round(avg(p), 3) AS "precision", round(avg(r), 3) AS recall, round(avg(f), 3) AS f1
FROM (SELECT c, hits, actual, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p,
        CASE WHEN actual = 0 THEN 0 ELSE hits / actual END AS r, 2 * hits / (predicted + actual) AS f
      FROM (SELECT c, sum(CASE WHEN y = c AND p = c THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS predicted,
              sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS actual
            FROM ({pairs}) CROSS JOIN (SELECT DISTINCT unnest([y, p]) AS c FROM ({pairs})) GROUP BY c))"""
_MODEL_PAIRS = {
    "guess": "SELECT label AS y, pred_y AS p FROM preds",
    "constant": "SELECT label AS y, 1 AS p FROM preds",
}


def _results(spark, folder):
    rows = a.predictions(spark, folder)
    return {
        "guess": evaluate.evaluate(rows),
        "constant": evaluate.evaluate(rows.withColumn("pred_y", F.lit(1))),
    }


@check(
    "j10_compare_models",
    a.using(a.PREDS)
    + ", ".join([""] + [f"m_{m} AS (SELECT * FROM ({_EVAL.format(pairs=q)}))" for m, q in _MODEL_PAIRS.items()])
    + """, long AS (
  SELECT 'guess' AS model, metric, value FROM (UNPIVOT m_guess ON accuracy, "precision", recall, f1 INTO NAME metric VALUE value)
  UNION ALL
  SELECT 'constant', metric, value FROM (UNPIVOT m_constant ON accuracy, "precision", recall, f1 INTO NAME metric VALUE value))
SELECT metric, max(CASE WHEN model = 'constant' THEN value END) AS constant, max(CASE WHEN model = 'guess' THEN value END) AS guess
FROM long GROUP BY metric""",
)
def compare_models_wide(spark, folder):
    return evaluate.compare_models_wide(_results(spark, folder))


def _stored(spark, folder):
    """Articles that have labels, as loaded by an earlier scan."""
    known = a.table(spark, folder, "labels").select(F.concat(F.lit("fb/"), "doc_id").alias("facebook_link"))
    return a.news(spark, folder).join(known, "facebook_link", "left_semi")


def _batch(spark, folder):
    """All articles with engagement moved up, down or not at all."""
    moved = F.col("facebook_interactions") + F.col("facebook_interactions") % 3 * 10 - 10
    return a.news(spark, folder).withColumn("facebook_interactions", moved)


_TWO_SCANS = f"""{a.NEWS},
stored AS (SELECT * FROM news WHERE facebook_link IN (SELECT 'fb/' || doc_id FROM labels)),
batch AS (SELECT * REPLACE (facebook_interactions + facebook_interactions % 3 * 10 - 10 AS facebook_interactions,
                            'scan_en' AS source) FROM news)"""
_BY_SOURCE = ", ".join(["facebook_link", "source", "facebook_interactions", "published"])


@check("u01_replace_source", "WITH " + _TWO_SCANS + "SELECT facebook_link, source FROM stored WHERE source <> 'scan_en' OR source IS NULL")
def replace_source(spark, folder):
    return mutate.delete_sources(_stored(spark, folder), ["scan_en"]).select("facebook_link", "source")


@check(
    "u02_upsert_scan",
    "WITH " + _TWO_SCANS + f""", kept AS (SELECT * FROM stored WHERE source <> 'scan_en')
SELECT {_BY_SOURCE} FROM kept k WHERE NOT EXISTS (
  SELECT 1 FROM batch b WHERE b.facebook_link = k.facebook_link AND b.facebook_interactions >= k.facebook_interactions)
UNION ALL
SELECT {_BY_SOURCE} FROM batch b WHERE NOT EXISTS (
  SELECT 1 FROM kept k WHERE b.facebook_link = k.facebook_link AND b.facebook_interactions < k.facebook_interactions)""",
)
def upsert_scan(spark, folder):
    done = mutate.upsert_scan(_stored(spark, folder), _batch(spark, folder), "scan_en")
    return done.select("facebook_link", "source", "facebook_interactions", "published")


@check(
    "u03_replace_by_key",
    a.using(a.LABELS)
    + """, batch AS (SELECT * REPLACE ('fresh' AS subindex) FROM labs WHERE list_contains(themes, 'en'))
SELECT facebook_link, subindex FROM labs WHERE facebook_link NOT IN (SELECT facebook_link FROM batch)
UNION ALL SELECT facebook_link, subindex FROM batch""",
)
def replace_by_key(spark, folder):
    rows = a.labels(spark, folder)
    batch = rows.where(F.array_contains("themes", "en")).withColumn("subindex", F.lit("fresh"))
    return mutate.replace_by_key(rows, batch).select("facebook_link", "subindex")


@check("u04_delete_sources", a.using(a.NEWS) + "SELECT facebook_link, source FROM news WHERE source NOT IN ('scan_de', 'scan_fr')")
def delete_sources(spark, folder):
    return mutate.delete_sources(a.news(spark, folder), ["scan_de", "scan_fr"]).select("facebook_link", "source")


@check(
    "u05_union_all",
    "SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier",
)
def union_all(spark, folder):
    customers = a.table(spark, folder, "customer").selectExpr("c_custkey as id", "c_nationkey as nation")
    suppliers = a.table(spark, folder, "supplier").selectExpr("s_nationkey as nation", "s_suppkey as id")
    return mutate.union_all(customers, suppliers)


@check(
    "u06_keep_first",
    a.using(a.SNAPS)
    + "SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY link, date_extracted ORDER BY published, event_id) = 1",
)
def keep_first(spark, folder):
    return first_per_group(a.snapshots(spark, folder), ["link", "date_extracted"], ["published", "event_id"])


@check("u07_value_list", a.using(a.SNAPS) + 'SELECT DISTINCT "index" FROM snaps WHERE "index" IS NOT NULL')
def value_list(spark, folder):
    return art.value_list(a.snapshots(spark, folder), "index")


@check(
    "u08_load_labels",
    a.using(a.LABELS)
    + """, batch AS (
  SELECT facebook_link, link, array_to_string(themes, ',') AS themes,
         CASE WHEN NOT list_contains(indexes, 'long') THEN NULL ELSE array_to_string(indexes, ',') END AS indexes, subindex
  FROM labs WHERE list_contains(themes, 'en')),
fresh AS (SELECT * FROM batch WHERE subindex IS NOT NULL OR indexes IS NOT NULL)
SELECT facebook_link, array_to_string(themes, '|') AS themes, array_to_string(indexes, '|') AS indexes, subindex
FROM labs WHERE facebook_link NOT IN (SELECT facebook_link FROM fresh)
UNION ALL
SELECT facebook_link, replace(themes, ',', '|'), replace(indexes, ',', '|'), subindex FROM fresh""",
)
def load_labels(spark, folder):
    rows = a.labels(spark, folder)
    indexes = F.when(F.array_contains("indexes", "long"), F.array_join("indexes", ","))
    batch = rows.where(F.array_contains("themes", "en")).withColumns(
        {"themes": F.array_join("themes", ","), "indexes": indexes}
    )
    done = mutate.load_labels(rows, batch)
    return done.select("facebook_link", joined("themes").alias("themes"), joined("indexes").alias("indexes"), "subindex")


@check("o01_sort", a.using(a.SNAPS) + "SELECT event_id, facebook_interactions FROM snaps ORDER BY facebook_interactions DESC, event_id")
def sort(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "facebook_interactions")
    return rows.orderBy(*order_by(["-facebook_interactions", "event_id"]))


@check("o02_mixed_sort", a.using(a.SNAPS) + "SELECT event_id, headline, published FROM snaps ORDER BY headline DESC, published, event_id")
def mixed_sort(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "headline", "published")
    return rows.orderBy(*order_by(["-headline", "published", "event_id"]))


_TOP_SQL = a.using(a.SNAPS) + "SELECT event_id, facebook_interactions FROM snaps ORDER BY facebook_interactions {} , event_id LIMIT 20"


@check("o03_limit_after_sort", _TOP_SQL.format("DESC"))
def limit_after_sort(spark, folder):
    return ranking.top_n(a.snapshots(spark, folder), ["-facebook_interactions", "event_id"], 20).select(
        "event_id", "facebook_interactions"
    )


@check("o04_smallest", _TOP_SQL.format("ASC"))
def smallest(spark, folder):
    return ranking.top_n(a.snapshots(spark, folder), ["facebook_interactions", "event_id"], 20).select(
        "event_id", "facebook_interactions"
    )


@check(
    "o05_limit_before_sort",
    a.using(a.SNAPS)
    + """SELECT event_id, facebook_interactions FROM snaps WHERE facebook_interactions < 1000
ORDER BY published, event_id LIMIT 15""",
)
def limit_before_sort(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "published", "facebook_interactions")
    sample = ranking.threshold_sample(rows, "facebook_interactions", 1000, ["published", "event_id"], above=False)
    return sample.select("event_id", "facebook_interactions")


@check(
    "o06_position",
    a.using(a.SNAPS) + "SELECT event_id, row_number() OVER (ORDER BY headline DESC, published, event_id) AS position FROM snaps",
)
def position(spark, folder):
    rows = a.snapshots(spark, folder).select("event_id", "headline", "published")
    return ranking.with_position(rows, ["-headline", "published", "event_id"]).select("event_id", "position")


@check(
    "o07_weekday_list",
    a.using(a.SNAPS) + "SELECT DISTINCT CAST(isodow(published) AS INTEGER) AS day_number, dayname(published) AS weekday FROM snaps",
)
def weekday_list(spark, folder):
    return art.weekday_list(a.snapshots(spark, folder), "published")
