"""Registered queries of this folder."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from pulse.llm import (
    byte_bpe,
    decontamination,
    filter_audit,
    language_id,
    license_scans,
    minhash_dedup,
    quality_rules,
    suffix_dedup,
    token_counts,
    token_ids,
    url_filters,
    vector_codes,
    warc,
)
from pulse.session import settle

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_token_counts(spark, folder):
    """Histogram of encoded lengths over all documents."""
    lengths = token_counts.encoded_lengths(documents(spark, folder))
    return token_counts.with_totals(settle(token_counts.length_histogram(lengths)))


@query
def op2_near_dedup(spark, folder):
    """Class and number of links of every document."""
    return minhash_dedup.classes(documents(spark, folder))


@query
def op3_decontamination(spark, folder):
    """Benchmark items found in documents."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.leaks(documents(spark, folder), items)


@query
def op4_quality_rules(spark, folder):
    """Word counts, base verdict and line-first verdict of every document."""
    return quality_rules.judge(documents(spark, folder)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op5_language_id(spark, folder):
    """Predicted language of every document, learnt from four fifths of them."""
    docs = documents(spark, folder)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def pipeline(spark, folder):
    """The whole pipeline of corpus_pipeline.py."""
    return corpus_pipeline.run(spark, folder)


#: Rules of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op6_url_filters(spark, folder):
    """Longest rule and verdict of every page."""
    return url_filters.judge(spark.read.parquet(f"{folder}/pages.parquet"), url_filters.rules_frame(spark, RULES))


@query
def op7_warc(spark, folder):
    """Response, metadata and conversion record of every page."""
    return warc.derivatives(spark.read.parquet(f"{folder}/pages.parquet"))


@query
def op8_license_scans(spark, folder):
    """License labels of every document."""
    return license_scans.scan(documents(spark, folder))


@query
def op9_token_ids(spark, folder):
    """Places and checksums of every document's ids, read back from the written shards."""
    return token_ids.round_trip(documents(spark, folder))


@query
def op10_bpe(spark, folder):
    """Digests of ids and of the decoded text of every document."""
    return byte_bpe.digests(documents(spark, folder))


@query
def op11_filter_audit(spark, folder):
    """Effect of every filter in every order of five filters, per source."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return filter_audit.audit(filter_audit.failures(documents(spark, folder), labels))


@query
def op12_vector_codes(spark, folder):
    """Code and errors of every vector after two rounds."""
    coded = vector_codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    coded = vector_codes.with_label_errors(settle(coded))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op13_suffix_dedup(spark, folder):
    """What is left of every document without repeated strings of 200 bytes."""
    return suffix_dedup.digests(documents(spark, folder))


ORACLES["op6_url_filters"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2
), p AS (SELECT DISTINCT part FROM c
), o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE strpos(filter_order, x) = 0 AND length(filter_order) < 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, substr(filter_order, 1, step - 1) AS before
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5
), r AS (
  SELECT c.part, filter_order, step, x, fails, n, good, toxic, strpos(fails, x) > 0 AS hit,
    length(translate(fails, before, '')) < length(fails) AS earlier FROM c, s
), t AS (
  SELECT part, filter_order, step, x,
    CAST(sum(CASE WHEN hit OR earlier THEN 0 ELSE n END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = x THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN hit AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""

ORACLES["op12_vector_codes"] = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT k, p, list_transform(embedding[p * 4 + 1 : p * 4 + 4], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM v, range(0, 16) r(p)
), b0 AS (SELECT p, k - 1 AS e, x FROM c WHERE k <= 64
), a1 AS (
  SELECT p, k, arg_min(e, d * 64 + e) AS e FROM (
    SELECT c.p, c.k, b.e, (c.x[1]-b.x[1])**2 + (c.x[2]-b.x[2])**2 + (c.x[3]-b.x[3])**2 + (c.x[4]-b.x[4])**2 AS d FROM c JOIN b0 b ON b.p = c.p
  ) GROUP BY 1, 2
), m1 AS (
  SELECT a.p, a.e, list_value(CAST(floor(sum(x[1]) / count(*)) AS BIGINT), CAST(floor(sum(x[2]) / count(*)) AS BIGINT),
    CAST(floor(sum(x[3]) / count(*)) AS BIGINT), CAST(floor(sum(x[4]) / count(*)) AS BIGINT)) AS x
  FROM a1 a JOIN c ON c.p = a.p AND c.k = a.k GROUP BY 1, 2
), b1 AS (SELECT b0.p, b0.e, coalesce(m1.x, b0.x) AS x FROM b0 LEFT JOIN m1 ON m1.p = b0.p AND m1.e = b0.e
), a2 AS (
  SELECT p, k, arg_min(e, d * 64 + e) AS e FROM (
    SELECT c.p, c.k, b.e, (c.x[1]-b.x[1])**2 + (c.x[2]-b.x[2])**2 + (c.x[3]-b.x[3])**2 + (c.x[4]-b.x[4])**2 AS d FROM c JOIN b1 b ON b.p = c.p
  ) GROUP BY 1, 2
), m2 AS (
  SELECT a.p, a.e, list_value(CAST(floor(sum(x[1]) / count(*)) AS BIGINT), CAST(floor(sum(x[2]) / count(*)) AS BIGINT),
    CAST(floor(sum(x[3]) / count(*)) AS BIGINT), CAST(floor(sum(x[4]) / count(*)) AS BIGINT)) AS x
  FROM a2 a JOIN c ON c.p = a.p AND c.k = a.k GROUP BY 1, 2
), b2 AS (SELECT b1.p, b1.e, coalesce(m2.x, b1.x) AS x FROM b1 LEFT JOIN m2 ON m2.p = b1.p AND m2.e = b1.e
), a3 AS (
  SELECT p, k, arg_min(e, d * 64 + e) AS e, CAST(min(d) AS BIGINT) AS d FROM (
    SELECT c.p, c.k, b.e, (c.x[1]-b.x[1])**2 + (c.x[2]-b.x[2])**2 + (c.x[3]-b.x[3])**2 + (c.x[4]-b.x[4])**2 AS d FROM c JOIN b2 b ON b.p = c.p
  ) GROUP BY 1, 2
), z AS (SELECT k, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY 1
), h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM z JOIN v ON v.k = z.k, h
"""

ORACLES["op13_suffix_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT k, i, hash(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT k, x, unnest(range(0, CAST(length(x) // 2 - 199 AS BIGINT))) AS i FROM d WHERE length(x) >= 400)
), r AS (
  SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 200, true) AS opens FROM w
  WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT k, i, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS span FROM r
), s AS (
  SELECT k, span, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2
), t AS (
  SELECT k, span, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS kept_from FROM s
), p AS (
  SELECT t.k, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept
  FROM t JOIN d ON d.k = t.k GROUP BY t.k
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p ON d.k = p.k
"""
