"""License scan by diagonal voting.

All rolling word 3-gram hashes of every text are joined to their places in license templates. Hits of
one text and template vote for the diagonal (place in the text less place in the template); diagonals at
most ``GAP`` apart are merged and the merged span is verified by the share of template words its hits
cover. It must also hold the template's distinguishing words (third item of a template), on one diagonal,
so side by side: usual words such as "released under the" verify nothing. A template of fewer than ``SHORT``
words that names none must stand whole. Null texts count as empty; texts without words get nulls, zeros and empty labels. Rows that
repeat id and text get the same result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K, GAP, SHARE, SHORT = 3, 2, 0.6, 12
#: Templates of more grams than this are joined by a shuffle instead of a broadcast.
BROADCAST_GRAMS = 100_000

# Phrases with their labels, and the usual words of public licenses and notices.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit-notice", "released under the mit license", "mit license"),
    ("apache-notice", "licensed under the apache license version 2 0", "apache license"),
    ("gpl-notice", "under the terms of the gnu general public license", "gnu general public license"),
    ("gnu-gpl", "gnu general public license", "gnu general public license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams_of(words: Column, k: int = K) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(k)))))


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    here = lambda w, i: w == parts[0]
    starts = F.filter(
        F.transform(words, lambda w, i: F.when(here(w, i), i)), lambda i: i.isNotNull()
    )

    def whole(i: Column) -> Column:
        test = F.lit(True)
        for j, part in enumerate(parts[1:], 1):
            test = test & F.coalesce(F.get(words, i + j) == part, F.lit(False))
        return test

    return F.filter(starts, whole)


def _core(words: str, core: str | None = None) -> tuple[int, int]:
    """First place of the words a span must hold, and the place after them; (0, 0) for none."""
    every = words.split()
    part = core.split() if core else every if len(every) < SHORT else []
    return next((i, i + len(part)) for i in range(len(every) + 1) if every[i : i + len(part)] == part)


def _row(doc_id: str, text: str) -> Column:
    """128 bits for rows with the same id and text: two independent hashes."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("second"), doc_id, text).alias("b")).alias("uid")


def spans(docs: DataFrame, templates: list[tuple[str, ...]], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Verified spans: row key, label, first and last word of the span, share of the template found."""
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(label, words, len(words.split()), *_core(words, *core)) for label, words, *core in templates],
        "label string, words string, size int, low int, high int",
    )
    grams = table.select("label", "size", "low", "high", F.posexplode(grams_of(F.split("words", " "))).alias("at", "gram"))
    if sum(len(w.split()) for _, w, *_ in templates) <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    # Words are a column of their own, so that they are cut once per text and not once per gram.
    cut = docs.select(_row(doc_id, text), words_of(F.col(text)).alias("words"))
    rows = cut.select("uid", F.posexplode(grams_of(F.col("words"))).alias("pos", "gram"))
    hits = rows.join(grams, "gram").select("uid", "label", "size", "low", "high", "pos", "at").distinct()
    votes = hits.groupBy("uid", "label", "size", "low", "high", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    # The grams of one diagonal that lie over the distinguishing words cover each of them.
    places = F.sequence("low", F.col("high") - 1)
    held = F.forall(places, lambda p: F.exists("ats", lambda a: (a <= p) & (p < a + K)))
    along = Window.partitionBy("uid", "label").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    merged = (
        votes.withColumn("_held", F.when(F.col("high") > F.col("low"), held).otherwise(True))
        .withColumn("_new", F.when(gap <= GAP, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(along))
        .groupBy("uid", "label", "size", "low", "high", "_run")
        .agg(F.flatten(F.collect_list("ats")).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("_held").alias("_held"))
    )
    found = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (K - 1)))))
    return (
        merged.withColumn("share", F.size(found) / F.col("size"))
        .where((F.col("share") >= SHARE) & F.col("_held"))
        .select("uid", "label", "first", (F.col("last") + (K - 1)).alias("last"), "share")
    )


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=None) -> DataFrame:
    """One row per document: word counts, phrase places, labels of phrases and templates, best share."""
    marked = docs.select(F.col(doc_id).alias("doc_id"), _row(doc_id, text), words_of(F.col(text)).alias("words"))
    maybe = F.array_contains("words", "license")
    places = [F.when(maybe, _phrase_places(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for p, _ in PHRASES]
    counted = marked.select(
        "doc_id", "uid", F.size("words").cast("long").alias("n_words"), *(p.alias(f"_p{i}") for i, p in enumerate(places))
    )
    named = [F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]
    every = F.concat(*(f"_p{i}" for i in range(len(PHRASES))))
    base = counted.select(
        "doc_id",
        "uid",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(F.array_compact(F.array(*named)))).alias("_base"),
    )
    best = spans(docs, templates or TEMPLATES, text, doc_id).groupBy("uid").agg(
        F.collect_set("label").alias("_more"), F.max("share").alias("score")
    )
    return base.join(best, "uid", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(
            F.sort_array(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))), ","
        ).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
