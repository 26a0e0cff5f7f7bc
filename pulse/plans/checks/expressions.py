"""Scalar, text, date, list and vector functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulse.functions import dates, text, values
from pulse.operators import articles as art
from pulse.operators import features, snapshots
from pulse.operators.models import HashingEncoder, as_array, embed_phrase
from pulse.plans.checks import adapters as a
from pulse.plans.checks.registry import check, joined, r6
from pulse.plans.checks.selection import SELECTED, selected
from pulse.sources.files import sanitise_columns

# The word pattern in the other dialect.
_WORD = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)


def words_sql(column: str) -> str:
    return f"regexp_extract_all({column}, '{_WORD}')"


@check("f01_fold", "SELECT c_custkey, lower(c_name) AS name FROM customer")
def fold(spark, folder):
    return a.table(spark, folder, "customer").select("c_custkey", text.fold("c_name").alias("name"))


@check("f02_sanitise", "SELECT c_custkey AS customer_key, c_name AS link_url FROM customer")
def sanitise(spark, folder):
    rows = a.table(spark, folder, "customer")
    return sanitise_columns(rows.select(F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("Link URL")))


@check(
    "f03_split",
    a.using(a.SNAPS)
    + """SELECT event_id, array_to_string(string_split(theme || ', ' || "index", ','), '|') AS items, theme, "index",
  ' ' || "index" AS untrimmed FROM snaps""",
)
def split(spark, folder):
    rows = a.snapshots(spark, folder)
    label = F.concat("theme", F.lit(" > "), "index")
    return rows.select(
        "event_id",
        joined(text.split_list(F.concat("theme", F.lit(", "), "index"))).alias("items"),
        text.label_part(label, 0).alias("theme"),
        text.label_part(label, 1, trim=False).alias("index"),
        F.try_element_at(F.split(label, ">"), F.lit(2)).alias("untrimmed"),
    )


@check(
    "f04_list_literal",
    a.using(a.SNAPS)
    + """SELECT event_id, theme || ' > ' || "index" AS first, theme || ' > ' || "index" || '|other''s > x' AS items,
  theme || ' > ' || "index" || '|other''s > x' AS parsed FROM snaps""",
)
def list_literal(spark, folder):
    rows = a.raw_snapshots(spark, folder)
    return rows.select(
        "event_id",
        text.first_literal_item("suggested_labels").alias("first"),
        joined(text.literal_items("suggested_labels")).alias("items"),
        joined(text.parse_list_literal("suggested_labels")).alias("parsed"),
    )


@check(
    "f05_join_text",
    a.using(a.NEWS, a.LABELS)
    + """SELECT n.facebook_link, n.headline || ' ' || n.summary AS text, n.domain || ' > ' || coalesce(l.subindex, '') AS label
FROM news n LEFT JOIN labs l ON n.facebook_link = l.facebook_link""",
)
def join_text(spark, folder):
    rows = art.with_labels(a.news(spark, folder), a.labels(spark, folder))
    return rows.select(
        "facebook_link",
        text.join_text(F.col("headline"), F.col("summary")).alias("text"),
        text.join_label(F.col("domain"), F.col("subindex")).alias("label"),
    )


@check(
    "f06_describe_features",
    a.using(a.ARTICLES)
    + """SELECT doc_id, headline || ' There are ' || facebook_interactions || ' mean monthly visitors to the website and '
  || doc_id || ' mean monthly unique visitors to the website.' || ' The article was published on the '
  || CASE WHEN isodow(published) = 1 THEN 'Monday' ELSE dayname(published) END || ' day of the week.' AS headline FROM arts""",
)
def describe_features(spark, folder):
    rows = a.articles(spark, folder).select(
        "doc_id",
        "headline",
        F.col("facebook_interactions").alias("mean_monthly_visits"),
        F.col("doc_id").alias("mean_monthly_unique_visitors"),
        dates.weekday_name("published").alias("day_of_week_published"),
    )
    columns = ["mean_monthly_visits", "mean_monthly_unique_visitors", "day_of_week_published"]
    return features.describe_features(rows, columns, into="headline").select("doc_id", "headline")


_TOP = "max({0}) OVER ()"


def _bin_sql(value: str, cuts: tuple) -> str:
    return (
        f"CASE WHEN {value} < {cuts[0]} THEN 'lowest' WHEN {value} < {cuts[1]} THEN 'low' "
        f"WHEN {value} < {cuts[2]} THEN 'moderate' ELSE 'high' END"
    )


@check(
    "f06_bin_features",
    a.using(a.ARTICLES)
    + ", v AS (SELECT doc_id, facebook_interactions / max(facebook_interactions) OVER () AS visits, facebook_interactions % 20 AS words, published FROM arts) "
    + f"SELECT doc_id, {_bin_sql('visits', (0.25, 0.5, 0.75))} AS mean_monthly_visits, "
    + f"{_bin_sql('words', (5, 10, 15))} AS text_non_stop_word_count, dayname(published) AS day_of_week_published FROM v",
)
def bin_features(spark, folder):
    rows = a.articles(spark, folder).select(
        "doc_id",
        F.col("facebook_interactions").alias("mean_monthly_visits"),
        (F.col("facebook_interactions") % 20).alias("text_non_stop_word_count"),
        dates.day_of_week("published").alias("day_of_week_published"),
    )
    return features.bin_features(rows)


@check(
    "f07_word_counts",
    f"""SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS words,
  CAST(len(list_filter({words_sql('lower(text)')}, lambda w: w NOT IN ({_STOP}))) AS INTEGER) AS non_stop_words,
  CAST(len(list_distinct({words_sql('text')})) AS INTEGER) AS unique_words FROM documents""",
)
def word_counts(spark, folder):
    rows = features.word_features(a.table(spark, folder, "documents"), ["text"])
    return rows.select(
        "doc_id",
        F.col("text_word_count").alias("words"),
        F.col("text_non_stop_word_count").alias("non_stop_words"),
        F.col("text_unique_word_count").alias("unique_words"),
    )


@check("f07_word_expressions", f"""SELECT conv_id, turn, CAST(len({words_sql('text')}) AS INTEGER) AS words,
  CAST(len(list_filter({words_sql('lower(text)')}, lambda w: w NOT IN ({_STOP}))) AS INTEGER) AS non_stop_words,
  CAST(len(list_distinct({words_sql('text')})) AS INTEGER) AS unique_words FROM conversations""")
def word_expressions(spark, folder):
    return a.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        text.word_count("text").alias("words"),
        text.non_stop_word_count("text").alias("non_stop_words"),
        text.unique_word_count("text").alias("unique_words"),
    )


LEXICON = f"""lex AS (
  SELECT word, (length(word) % 5 - 2) / 2.0 AS polarity, (length(word) % 3) / 2.0 AS subjectivity
  FROM (SELECT DISTINCT unnest({words_sql('lower(text)')}) AS word FROM benchmark))"""


@check(
    "f08_lexicon_score",
    f"""WITH {LEXICON},
tokens AS (SELECT doc_id, unnest({words_sql('lower(text)')}) AS word FROM documents),
scores AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM tokens JOIN lex ON tokens.word = lex.word GROUP BY 1)
SELECT d.doc_id, round(coalesce(p, 0), 6) AS sentiment, round(coalesce(s, 0), 6) AS subjectivity
FROM documents d LEFT JOIN scores ON d.doc_id = scores.doc_id""",
)
def lexicon_score(spark, folder):
    rows = a.table(spark, folder, "documents").select("doc_id", F.col("text").alias("headline"))
    scored = features.lexicon_scores(rows, "doc_id", ["headline"], a.lexicon(spark, folder))
    return scored.select("doc_id", r6("headline_sentiment").alias("sentiment"), r6("headline_subjectivity").alias("subjectivity"))


_TURNING = ("no", "the", "der")
_FLAT = "replace(t.word, chr(8217), chr(39))"


@check(
    "f08_context_score",
    f"""WITH {LEXICON},
scale AS (SELECT word, polarity, subjectivity, CASE length(word) WHEN 2 THEN 1.25 WHEN 8 THEN 0.5 END AS intensity FROM lex),
raw AS (SELECT doc_id, {words_sql('text')} AS words FROM documents),
tokens AS (SELECT doc_id, regexp_replace(lower(unnest(words)), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS word,
  unnest(range(len(words))) AS pos FROM raw),
kinds AS (SELECT doc_id, pos, polarity, subjectivity, intensity, {_FLAT} IN {_TURNING} OR {_FLAT} LIKE '%n''t' AS turns
  FROM tokens t LEFT JOIN scale USING (word)),
heard AS (SELECT *, CASE WHEN turns THEN 'n' WHEN intensity IS NOT NULL THEN 'i' ELSE 's' END AS kind
  FROM kinds WHERE turns OR polarity IS NOT NULL),
parts AS (SELECT *, count(*) FILTER (kind = 's') OVER (PARTITION BY doc_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM heard),
turned AS (SELECT doc_id, part, pos, pos - lag(pos) OVER (PARTITION BY doc_id, part ORDER BY pos) <= 3 AS linked FROM parts WHERE kind = 'n'),
chains AS (SELECT doc_id, part, pos, count(*) FILTER (linked IS NOT TRUE) OVER (PARTITION BY doc_id, part ORDER BY pos) AS chain FROM turned),
ends AS (SELECT doc_id, part, arg_max(chain, pos) AS chain, max(pos) AS pos FROM chains GROUP BY 1, 2),
odd AS (SELECT e.doc_id, e.part, e.pos, count(*) % 2 = 1 AS odd FROM ends e
  JOIN chains c ON c.doc_id = e.doc_id AND c.part = e.part AND c.chain = e.chain GROUP BY 1, 2, 3),
boosts AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run, intensity FROM parts WHERE kind = 'i'),
runs AS (SELECT doc_id, max(pos) AS pos, product(intensity) AS boost FROM boosts GROUP BY doc_id, run),
scored AS (SELECT s.doc_id, s.polarity * coalesce(boost, 1) * CASE WHEN odd AND s.pos - o.pos <= 3 THEN -0.5 ELSE 1 END AS p,
  s.subjectivity * coalesce(boost, 1) AS s
  FROM parts s LEFT JOIN runs r ON r.doc_id = s.doc_id AND r.pos = s.pos - 1
  LEFT JOIN odd o ON o.doc_id = s.doc_id AND o.part = s.part WHERE kind = 's'),
means AS (SELECT doc_id, avg(greatest(-1, least(1, p))) AS p, avg(greatest(0, least(1, s))) AS s FROM scored GROUP BY 1)
SELECT d.doc_id, round(coalesce(p, 0), 6) AS sentiment, round(coalesce(s, 0), 6) AS subjectivity
FROM documents d LEFT JOIN means ON d.doc_id = means.doc_id""",
)
def context_score(spark, folder):
    rows = a.table(spark, folder, "documents").select("doc_id", F.col("text").alias("headline"))
    intensity = F.when(F.length("word") == 2, 1.25).when(F.length("word") == 8, 0.5)
    lexicon = a.lexicon(spark, folder).withColumn("intensity", intensity)
    scored = features.context_scores(rows, "doc_id", ["headline"], lexicon, _TURNING)
    return scored.select("doc_id", r6("headline_sentiment").alias("sentiment"), r6("headline_subjectivity").alias("subjectivity"))


@check(
    "f09_anchor",
    """SELECT page_id, '<a target="_blank" href="' || url || '">' || page_id || '</a>' AS link FROM pages""",
)
def anchor(spark, folder):
    rows = a.table(spark, folder, "pages")
    return rows.select("page_id", text.anchor(F.col("page_id").cast("string"), F.col("url")).alias("link"))


@check("f10_to_local", "SELECT event_id, ts + INTERVAL 8 HOUR AS published, ts AS offset_published FROM events")
def to_local(spark, folder):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return a.table(spark, folder, "events").select(
        "event_id",
        dates.to_local(stamp).alias("published"),
        dates.to_local(F.concat(stamp, F.lit("+08:00"))).alias("offset_published"),
    )


@check("f11_parts", "SELECT event_id, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M:%S') AS time FROM events")
def parts(spark, folder):
    return a.table(spark, folder, "events").select(
        "event_id", dates.date_part("ts").alias("date"), dates.time_part("ts").alias("time")
    )


@check(
    "f12_calendar_parts",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS day, CAST(hour(o_orderdate) AS INTEGER) AS hour,
  dayname(o_orderdate) AS name, CAST(strftime(o_orderdate, '%W') AS BIGINT) AS week FROM orders""",
)
def calendar_parts(spark, folder):
    return a.table(spark, folder, "orders").select(
        "o_orderkey",
        dates.day_of_week("o_orderdate").alias("day"),
        F.hour("o_orderdate").alias("hour"),
        dates.weekday_name("o_orderdate").alias("name"),
        dates.week_of_year("o_orderdate").alias("week"),
    )


@check(
    "f13_to_period",
    a.using(a.SNAPS)
    + "SELECT CAST(date_trunc('week', date_extracted) AS DATE) AS date_extracted, count(*) AS \"count\" FROM snaps GROUP BY 1",
)
def to_period(spark, folder):
    return snapshots.to_period(a.snapshots(spark, folder), "week").groupBy("date_extracted").count()


@check(
    "f14_bounds",
    a.using(a.NEWS)
    + """SELECT facebook_link FROM news WHERE published BETWEEN
  CAST((SELECT CAST(max(published) - INTERVAL 1 DAY AS DATE) FROM news) AS TIMESTAMP)
  AND CAST((SELECT CAST(max(published) AS DATE) FROM news) AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE""",
)
def bounds(spark, folder):
    rows = a.news(spark, folder)
    latest: dt.datetime = art.filter_bounds(rows).first()["max_date"]
    first, last = dates.bounds(dates.last_day(latest))
    return art.explore(rows, {"published": (first, last)}).select("facebook_link")


@check(
    "f15_numbers",
    """SELECT c_custkey, round(c_acctbal, 1) AS rounded, round(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS log,
  round(c_acctbal / max(c_acctbal) OVER (), 6) AS share, round(coalesce(1 / nullif(c_acctbal, 0), 0), 6) AS weight,
  CAST(c_nationkey AS VARCHAR) AS text FROM customer""",
)
def numbers(spark, folder):
    rows = a.table(spark, folder, "customer")
    shares = features.ratio_to_max(rows.withColumn("share", F.col("c_acctbal")), ["share"])
    return shares.select(
        "c_custkey",
        F.round("c_acctbal", 1).alias("rounded"),
        r6(values.natural_log("c_acctbal")).alias("log"),
        r6("share").alias("share"),
        r6(values.reciprocal("c_acctbal")).alias("weight"),
        F.col("c_nationkey").cast("string").alias("text"),
    )


@check(
    "f16_thousands",
    """SELECT c_custkey, format('{:,}', CAST(c_custkey * 1000 AS BIGINT)) AS whole, format('{:,.2f}', c_acctbal) AS parts FROM customer""",
)
def thousands(spark, folder):
    return a.table(spark, folder, "customer").select(
        "c_custkey",
        text.thousands(F.col("c_custkey") * 1000).alias("whole"),
        text.thousands("c_acctbal", 2).alias("parts"),
    )


@check("f17_nan_to_zero", "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS value FROM events")
def nan_to_zero(spark, folder):
    value = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    return a.table(spark, folder, "events").select("event_id", values.nan_to_zero(value).alias("value"))


@check(
    "f18_lists",
    "WITH " + SELECTED + """
SELECT facebook_link, array_to_string(list_concat(themes, indexes), ', ') AS both, list_contains(themes, 'en') AS english,
  CAST(len(indexes) AS INTEGER) AS n_indexes FROM sel""",
)
def lists(spark, folder):
    rows = art.filled_lists(selected(spark, folder))
    return rows.select(
        "facebook_link",
        F.array_join("themes_indexes", ", ").alias("both"),
        F.array_contains("themes", "en").alias("english"),
        F.size("indexes").alias("n_indexes"),
    )


@check("f18_distinct_labels", "WITH " + SELECTED + "SELECT DISTINCT unnest(indexes) AS indexes FROM sel")
def distinct_labels(spark, folder):
    return art.distinct_labels(selected(spark, folder), "indexes")


@check(
    "f19_labels_from_mask",
    """SELECT doc_id, array_to_string(list_filter(['quality', 'toxic'], lambda x: (x = 'quality' AND quality = 1) OR (x = 'toxic' AND toxic = 1)), '|') AS labels
FROM labels""",
)
def labels_from_mask(spark, folder):
    mask = F.array(F.col("quality") == 1, F.col("toxic") == 1)
    names = F.array(F.lit("quality"), F.lit("toxic"))
    rows = a.table(spark, folder, "labels")
    return rows.select("doc_id", joined(values.labels_from_mask(names, mask)).alias("labels"))


@check(
    "f20_labels_by_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, string_agg(name, '|' ORDER BY score DESC, name) AS labels FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, unnest(['discount', 'quantity', 'tax']) AS name,
         unnest([l_discount * 10, l_quantity / 50, l_tax * 10]) AS score,
         row_number() OVER () AS r FROM lineitem) GROUP BY l_orderkey, l_linenumber, l_partkey, r""",
)
def labels_by_score(spark, folder):
    names = F.array(F.lit("discount"), F.lit("quantity"), F.lit("tax"))
    scores = F.array(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 10)
    return a.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", joined(values.labels_by_score(names, scores)).alias("labels")
    )


@check(
    "f21_cosine",
    a.using(a.VECTORS)
    + """, first AS (SELECT vector AS seed FROM vecs ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(vector, seed), 6) AS similarity FROM vecs, first""",
)
def cosine(spark, folder):
    rows = a.vectors(spark, folder)
    seed = F.lit([float(x) for x in rows.orderBy("vec_id").select("vector").first()[0]])
    return rows.select("vec_id", r6(values.cosine("vector", seed)).alias("similarity"))


@check(
    "f22_extract_meta",
    r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<meta[^>]*property=["'']og:image') THEN 'found' END AS thumbnail,
  regexp_extract(html, '(?i)<meta[^>]*charset="([^"]*)"', 1) AS charset, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang
FROM pages""",
)
def extract_meta(spark, folder):
    return a.table(spark, folder, "pages").select(
        "page_id",
        text.extract_meta("html", "og:image").alias("thumbnail"),
        text.tag_attribute("html", "meta", "charset").alias("charset"),
        text.tag_attribute("html", "html", "lang").alias("lang"),
    )


@check("f23_embed_phrase")
def phrase(spark, folder):
    """Documents by likeness to a phrase, which is embedded with the documents' encoder."""
    from pulse.operators.similarity import with_similarity

    rows = a.articles(spark, folder).select("doc_id", "headline")
    encoder = HashingEncoder.fit(rows, "headline", 1024)
    seed = as_array(embed_phrase(spark, "the quality of the report", encoder))
    scored = with_similarity(as_array(encoder.transform(rows, "headline")), seed)
    return scored.select("doc_id", r6("similarity").alias("similarity"))
