"""Line-first cleaning: rules per line first, then documents that lose too much text go.

Every column is an expression over one row, so nothing is shuffled. A null text has no words and fails
the base rules, an empty one too. Repeated rows are judged alike; other columns pass through untouched
unless they have the name of a result column, which is then replaced. An empty table gives no rows; the time for a
text grows in proportion to its length (and its logarithm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Lines of up to BOILERPLATE_WORDS words with one of these are boilerplate.
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|accept cookies|"
    r"enable javascript|subscribe to our newsletter|click here|sign up now|read more|share on facebook|lorem ipsum)"
)
BOILERPLATE_WORDS = 20
#: More symbols, shouted words or separators than this share of a line's words make the line fail.
SYMBOL_SHARE, SHOUT_SHARE, MENU_SHARE = 0.2, 0.5, 0.3
#: A line of this many words without any punctuation fails.
BARE_WORDS = 60
#: A document goes when its failed lines hold more than this share of the characters of all words.
LOST_SHARE = 0.5


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, k: int = 8) -> Column:
    """Words inside ``k``-word windows found twice or more in the list, first places included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(places, i + 1) - p, F.lit(k))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        hits = F.filter(
            pairs,
            lambda x, i: (x["h"] == F.get(pairs, i + 1)["h"]) | (F.when(i > 0, F.get(pairs, i - 1)["h"]) == x["h"]),
        )
        return F.array_sort(F.transform(hits, lambda x: x["p"]))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(pairs, places), covered)
        )

    return F.when(F.size(words) < k + 1, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a punctuation, navigation or boilerplate rule."""
    n = F.size(F.split(F.trim(line), r"[\x20\x09-\x0D]+"))
    symbols = F.regexp_count(line, F.lit(SYMBOL))
    shouts = F.regexp_count(line, F.lit(r"!!"))
    menu = F.regexp_count(line, F.lit(r"[|»›•·]"))
    bare = ~line.rlike(r"[.,;:!?…。，！？،؟।]")
    return (
        (symbols > SYMBOL_SHARE * n)
        | (shouts > SHOUT_SHARE * n)
        | (menu > MENU_SHARE * n)
        | ((n >= BARE_WORDS) & bare)
        | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "base_failed", "lost_chars", "kept"
]


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts, ``base_failed``, ``clean_text`` (the lines kept), ``lost_chars`` and ``kept``.

    All results of a text are one struct that a generator unpacks. A filter on them cannot move below the
    generator, where it would cut the text into words again for every window.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.struct(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))

    def counted(x: Column) -> Column:
        words, lines = x["words"], x["lines"]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.array_join(F.filter(lines, lambda line: ~line_fails(line)), "\n").alias("clean_text"),
        )

    def decided(x: Column) -> Column:
        failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
        left = F.length(F.regexp_replace(x["clean_text"], r"[\x20\x09-\x0D]+", "")).cast("long")
        return let(
            F.struct(failed.alias("failed"), (x["word_chars"] - left).alias("lost")),
            lambda y: F.struct(
                *(x[c].alias(c) for c in RESULTS[:6]),
                y["failed"].alias("base_failed"),
                y["lost"].alias("lost_chars"),
                (~y["failed"] & (y["lost"] <= LOST_SHARE * x["word_chars"])).alias("kept"),
            ),
        )

    result = let(let(parts, counted), decided)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    return docs.select(*others, F.inline(F.array(result)))
