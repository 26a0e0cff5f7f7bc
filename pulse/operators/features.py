"""Article features for models: timing, words, lexicon scores, publisher traffic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions import dates, domains, text, values
from pulse.operators.ordered import HOT_ROWS, broadcast_if_small, first_per_group, with_lag

TEXTS = ("headline", "summary", "text")

# Class number of each traction label.
LABEL_CODES = {"diminishing": 0, "neutral": 1, "trending": 2}

# Upper bounds of lowest, low and moderate for each feature.
CUTS = {
    "mean_monthly_visits": (0.25, 0.5, 0.75),
    "mean_monthly_unique_visitors": (0.25, 0.5, 0.75),
    "hours_since_published": (1, 2, 3),
    "text_non_stop_word_count": (5, 10, 15),
    "text_subjectivity": (0.25, 0.5, 0.75),
    "text_sentiment": (-0.25, 0, 0.25),
}

# Columns put in relation to their maximum before binning.
RELATIVE_TO_MAX = ("mean_monthly_visits", "mean_monthly_unique_visitors")


def unique_articles(df: DataFrame, ties: Sequence[str] = (), min_rows: int = 2) -> DataFrame:
    """First snapshot per headline and time, from indexes with at least ``min_rows`` articles."""
    first = first_per_group(df, ["headline", "published"], ["date_extracted", *ties])
    sizes = first.groupBy("article_index").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min_rows)
    return first.join(sizes.select("article_index"), "article_index", "left_semi")


def hours_since_previous(
    df: DataFrame, key: str = "article_index", ties: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Hours since the previous article of the same index; 0 for the first."""
    lagged = with_lag(df, [key], ["published", *ties], {"_before": "published"}, hot_rows)
    # Articles without an index belong to no series.
    gap = F.when(F.col(key).isNotNull(), dates.hours_between("published", "_before"))
    hours = F.coalesce(gap, F.lit(0.0))
    return lagged.withColumn("hours_since_published", hours).drop("_before")


# Texts that are two others with a space between: their words are the words of both.
JOINED = {"text": ("headline", "summary")}


def _parts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The columns to cut into words for each text."""
    return {c: JOINED[c] if c in JOINED and set(JOINED[c]) <= set(df.columns) else (c,) for c in columns}


def word_features(df: DataFrame, columns: Sequence[str] = TEXTS) -> DataFrame:
    """Word, non-stop-word and distinct-word counts of each text column.

    Each text is cut into words once; a joined text reuses the words of its parts.
    """
    parts = _parts(df, columns)
    cut = sorted({p for group in parts.values() for p in group})
    split = df.withColumns({f"_words_{p}": text.words(p) for p in cut})
    counted = split.withColumns(
        {f"_{kind}_{p}": count(F.col(f"_words_{p}")) for p in cut for kind, count in (("all", F.size), ("rare", text.count_non_stop))}
    )
    results: dict[str, Column] = {}
    for c, group in parts.items():
        # Counts of a joined text add up; only its distinct words need both parts.
        results[f"{c}_word_count"] = reduce(add, [F.col(f"_all_{p}") for p in group])
        results[f"{c}_non_stop_word_count"] = reduce(add, [F.col(f"_rare_{p}") for p in group])
        found = F.concat(*[f"_words_{p}" for p in group]) if len(group) > 1 else F.col(f"_words_{c}")
        results[f"{c}_unique_word_count"] = F.size(F.array_distinct(found))
    return counted.withColumns(results).drop(*[f"_{k}_{p}" for p in cut for k in ("words", "all", "rare")])


# Most words of a lexicon that every task may hold; more are joined by a shuffle.
LEXICON_ROWS = 200_000


def lexicon_scores(
    df: DataFrame, key: str, columns: Sequence[str], lexicon: DataFrame, lexicon_rows: int = LEXICON_ROWS
) -> DataFrame:
    """Mean polarity and subjectivity of the words of each text found in a lexicon.

    ``lexicon`` has ``word``, ``polarity`` and ``subjectivity`` with one row per
    word, and ``key`` is unique. A lexicon of checked, moderate size is sent to all
    tasks, which then sum per text before the shuffle; for a larger one, words are
    counted per text first. The sums of a joined text are those of its parts. A text
    without a known word scores 0 on both.
    """
    parts = _parts(df, columns)
    cut = sorted({p for group in parts.values() for p in group})
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.col(p).alias("body")) for i, p in enumerate(cut)])
    texts = df.select(key, F.explode(listed).alias("text"))
    tokens = texts.select(key, "text.place", F.explode(text.words(F.lower("text.body"))).alias("word"))
    scores = lexicon.select("word", "polarity", "subjectivity")
    sized = broadcast_if_small(scores, lexicon_rows)
    if sized is scores:
        counted = tokens.groupBy(key, "place", "word").agg(F.count("*").alias("times"))
    else:
        counted = tokens.withColumn("times", F.lit(1))
    scored = counted.join(sized, "word")
    sums = []
    for i, p in enumerate(cut):
        here = F.when(F.col("place") == i, F.col("times"))
        sums += [
            F.sum(here).alias(f"_n_{p}"),
            F.sum(here * F.col("polarity")).alias(f"_p_{p}"),
            F.sum(here * F.col("subjectivity")).alias(f"_s_{p}"),
        ]
    joined = df.join(scored.groupBy(key).agg(*sums), key, "left")

    def mean(kind: str, group: tuple[str, ...]) -> Column:
        total, words = (sum((F.coalesce(f"_{k}_{p}", F.lit(0)) for p in group), F.lit(0)) for k in (kind, "n"))
        return F.coalesce(F.try_divide(total, words), F.lit(0.0))

    results = {}
    for c, group in parts.items():
        results[f"{c}_sentiment"] = mean("p", group)
        results[f"{c}_subjectivity"] = mean("s", group)
    return joined.withColumns(results).drop(*[f"_{k}_{p}" for k in "nps" for p in cut])


# Words that turn the polarity of what follows.
NEGATIONS = ("no", "not", "never", "none", "nor", "cannot", "without")


def _word_stem(word: Column) -> Column:
    """A lower-case word without punctuation around it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def context_scores(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    lexicon: DataFrame,
    negations: Sequence[str] = NEGATIONS,
    window: int = 3,
    turn: float = -0.5,
    lexicon_rows: int = LEXICON_ROWS,
) -> DataFrame:
    """Polarity and subjectivity of each text, where words before a scored word change its score.

    ``lexicon`` has ``word``, ``polarity``, ``subjectivity`` and ``intensity``, one row per
    word; ``key`` is unique. A word with an intensity is an intensifier: it scores nothing
    itself but multiplies polarity and subjectivity of a scored word right after it, and a
    row of them multiplies all their intensities. A negation, or a word that ends in
    ``n't``, multiplies the polarity of the first scored word among the ``window`` words
    after it by ``turn``; two of them cancel out. Scores stay within -1 to 1 and 0 to 1;
    a text scores the mean over its scored words, 0 without any, null or empty included.
    A negation that the lexicon lists is a negation. Words are lower-cased and lose
    punctuation at both ends before they are looked up.

    Only scored words, intensifiers and negations are gathered per text, so a task never
    holds more than one text's worth of them; they are folded in their order, natively.
    """
    parts = [F.struct(F.lit(i).alias("place"), F.col(c).alias("body")) for i, c in enumerate(columns)]
    texts = df.select(F.col(key).alias("_key"), F.explode(F.array(*parts)).alias("text"))
    tokens = texts.select("_key", "text.place", F.posexplode(text.words("text.body")).alias("at", "raw"))
    stem = _word_stem(F.col("raw"))
    tokens = tokens.select("_key", "place", "at", stem.alias("word"), F.translate(stem, "\u2019", "'").alias("flat"))
    turns = F.col("flat").isin(*negations) | F.col("flat").rlike("n't$")
    scores = lexicon.select(
        F.col("word"), *[F.col(c).cast("double").alias(c) for c in ("polarity", "subjectivity", "intensity")]
    )
    known = tokens.join(broadcast_if_small(scores, lexicon_rows), "word", "left").withColumn("turns", turns)
    heard = known.where(F.col("turns") | F.col("intensity").isNotNull() | F.col("polarity").isNotNull())
    item = F.struct("at", "turns", "intensity", "polarity", "subjectivity")
    rows = heard.groupBy("_key", "place").agg(F.array_sort(F.collect_list(item)).alias("items"))

    nothing = F.struct(
        F.lit(0.0).alias("polarity"),
        F.lit(0.0).alias("subjectivity"),
        F.lit(0).alias("scored"),
        F.lit(1.0).alias("boost"),
        F.lit(-2).alias("boosted"),
        F.lit(1.0).alias("factor"),
        F.lit(-1).alias("until"),
    )

    def fold(state: Column, item: Column) -> Column:
        at = item["at"]
        # What earlier words still mean at this place.
        boost = F.when(state["boosted"] == at - 1, state["boost"]).otherwise(1.0)
        factor = F.when(at <= state["until"], state["factor"]).otherwise(1.0)
        boosts = ~item["turns"] & item["intensity"].isNotNull()
        scores = ~item["turns"] & item["intensity"].isNull()
        polarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), item["polarity"] * boost * factor))
        subjectivity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(item["subjectivity"], F.lit(0.0)) * boost))
        turned = F.when(factor == 1.0, F.lit(float(turn))).otherwise(F.lit(1.0))
        return F.struct(
            (state["polarity"] + F.when(scores, polarity).otherwise(0.0)).alias("polarity"),
            (state["subjectivity"] + F.when(scores, subjectivity).otherwise(0.0)).alias("subjectivity"),
            (state["scored"] + F.when(scores, 1).otherwise(0)).alias("scored"),
            F.when(boosts, boost * item["intensity"]).otherwise(1.0).alias("boost"),
            F.when(boosts, at).otherwise(-2).alias("boosted"),
            F.when(item["turns"], turned).when(scores, 1.0).otherwise(factor).alias("factor"),
            F.when(item["turns"], at + window).when(scores, -1).otherwise(state["until"]).alias("until"),
        )

    folded = rows.select("_key", "place", F.aggregate("items", nothing, fold).alias("sums"))
    mean = lambda part: F.coalesce(F.try_divide(F.col(f"sums.{part}"), F.col("sums.scored")), F.lit(0.0))
    folded = folded.select("_key", "place", mean("polarity").alias("p"), mean("subjectivity").alias("s"))
    wide = folded.groupBy("_key").agg(
        *[F.max(F.when(F.col("place") == i, F.col(v))).alias(f"_{v}_{i}") for i in range(len(columns)) for v in "ps"]
    )
    joined = df.join(wide, F.col(key) == F.col("_key"), "left")
    results = {}
    for i, c in enumerate(columns):
        results[f"{c}_sentiment"] = F.coalesce(F.col(f"_p_{i}"), F.lit(0.0))
        results[f"{c}_subjectivity"] = F.coalesce(F.col(f"_s_{i}"), F.lit(0.0))
    return joined.withColumns(results).drop("_key", *[f"_{v}_{i}" for i in range(len(columns)) for v in "ps"])


def domain_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed publisher tables: domain to group (18 rows) and group to traffic (14 rows)."""
    groups = spark.createDataFrame(list(domains.DOMAIN_GROUPS.items()), "domain string, domain_group string")
    traffic = spark.createDataFrame(
        [(g, *t) for g, t in domains.GROUP_TRAFFIC.items()],
        "domain_group string, mean_monthly_visits bigint, mean_monthly_unique_visitors bigint",
    )
    return groups, traffic


def keep_known_domains(df: DataFrame) -> DataFrame:
    """Articles of the publishers in the fixed table."""
    return df.where(F.col("domain").isin(*domains.DOMAIN_GROUPS))


def with_traffic(df: DataFrame) -> DataFrame:
    """Add publisher group and monthly traffic by domain.

    Both tables are fixed and tiny, so they are broadcast.
    """
    groups, traffic = domain_tables(df.sparkSession)
    return df.join(F.broadcast(groups), "domain", "left").join(F.broadcast(traffic), "domain_group", "left")


def one_hot(df: DataFrame, column: str, categories: Sequence | None = None, limit: int = 1_000) -> DataFrame:
    """Replace a category by one 0/1 column per value.

    Without a list the values are read from the data; more than ``limit`` of them
    is an error, since each becomes a column.
    """
    if categories is None:
        found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{column} has more than {limit} values; pass the categories to encode")
        categories = sorted(row[0] for row in found)
    flags = {f"{column}_{c}": F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)) for c in categories}
    return df.withColumns(flags).drop(column)


def label_codes(df: DataFrame, column: str = "label") -> DataFrame:
    """Traction labels as class numbers 0, 1 and 2."""
    return df.withColumn(column, values.lookup(column, LABEL_CODES))


def ratio_to_max(df: DataFrame, columns: Sequence[str] = RELATIVE_TO_MAX) -> DataFrame:
    """Divide columns by their largest value."""
    top = df.select(F.struct(*[F.max(c).cast("double").alias(c) for c in columns]).alias("top")).scalar()
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), top.getField(c)) for c in columns})


def bin_features(df: DataFrame) -> DataFrame:
    """Replace numeric features by lowest, low, moderate or high, and weekday numbers by names."""
    present = {c: values.bin4(c, cuts) for c, cuts in CUTS.items() if c in df.columns}
    scaled = ratio_to_max(df, [c for c in RELATIVE_TO_MAX if c in df.columns])
    binned = scaled.withColumns(present)
    if "day_of_week_published" in df.columns:
        names = {n + 1: name for n, name in enumerate(dates.WEEKDAYS)}
        binned = binned.withColumn("day_of_week_published", values.lookup("day_of_week_published", names))
    return binned


# The sentence each feature adds to an article's text.
SENTENCES = [
    (" There are ", "mean_monthly_visits", " mean monthly visitors to the website and "),
    ("", "mean_monthly_unique_visitors", " mean monthly unique visitors to the website."),
    (" The article was published ", "hours_since_published", " hours after the last article of the same theme was published."),
    (" The article was published on the ", "day_of_week_published", " day of the week."),
    (" The article was published at the ", "hour_of_day_published", " hour of the day."),
    (" The headline has ", "text_non_stop_word_count", " non-stop words."),
    (" The text has a subjectivity score of ", "text_subjectivity", " and a sentiment score of "),
    ("", "text_sentiment", "."),
]


def describe_features(df: DataFrame, columns: Sequence[str] = RELATIVE_TO_MAX, into: str = "text") -> DataFrame:
    """Append the chosen features to the text as sentences."""
    parts = [F.col(into)]
    for before, column, after in SENTENCES:
        if column in columns:
            parts += [F.lit(before), F.col(column).cast("string"), F.lit(after)]
    return df.withColumn(into, F.concat(*parts))


def timing_features(df: DataFrame) -> DataFrame:
    """Weekday from 1 for Monday, and hour of publication."""
    return df.withColumns(
        {
            "day_of_week_published": dates.day_of_week("published"),
            "hour_of_day_published": F.hour("published"),
        }
    )
