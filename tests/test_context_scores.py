"""Scores with context against a word-by-word version."""

from __future__ import annotations

import random
import re

import pytest

from pulse.operators import features

LEXICON = {
    "good": (0.7, 0.6, None),
    "bad": (-0.7, 0.7, None),
    "awful": (-1.0, 1.0, None),
    "flat": (0.0, None, None),
    "very": (0.2, 0.3, 1.3),
    "slightly": (None, None, 0.5),
    "not": (-0.3, 0.2, None),
}


def brute(body: str | None) -> tuple[float, float]:
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in (body or "").split()]
    polarity, subjectivity, scored = 0.0, 0.0, 0
    for at, word in enumerate(words):
        if negates(word) or LEXICON.get(word, (None,) * 3)[2] is not None or LEXICON.get(word, (None,))[0] is None:
            continue
        boost, before = 1.0, at - 1
        while before >= 0 and not negates(words[before]) and LEXICON.get(words[before], (None,) * 3)[2] is not None:
            boost *= LEXICON[words[before]][2]
            before -= 1
        # Negations since the last scored word, each alive for three words.
        factor, until = 1.0, -1
        for i in range(at):
            if negates(words[i]):
                factor = -0.5 if not (i <= until and factor != 1.0) else 1.0
                until = i + 3
            elif words[i] in LEXICON and LEXICON[words[i]][2] is None:
                factor, until = 1.0, -1
        factor = factor if at <= until else 1.0
        p, s, _ = LEXICON[word]
        polarity += max(-1.0, min(1.0, p * boost * factor))
        subjectivity += max(0.0, min(1.0, (s or 0.0) * boost))
        scored += 1
    return (polarity / scored, subjectivity / scored) if scored else (0.0, 0.0)


def negates(word: str) -> bool:
    return word.replace("’", "'") in features.NEGATIONS or word.replace("’", "'").endswith("n't")


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(w, *v) for w, v in LEXICON.items()]
    return spark.createDataFrame(rows, "word string, polarity double, subjectivity double, intensity double")


def scores(spark, lexicon, bodies, **options):
    rows = spark.createDataFrame([(i, b, "bad") for i, b in enumerate(bodies)], "id int, headline string, _key string")
    done = features.context_scores(rows.withColumnRenamed("_key", "summary"), "id", ["headline", "summary"], lexicon, **options)
    found = done.orderBy("id").collect()
    assert all(r["summary_sentiment"] == -0.7 for r in found)
    return [(r["headline_sentiment"], r["headline_subjectivity"]) for r in found]


def test_single_rules(spark, lexicon):
    bodies = ["good", "very good", "Very, very GOOD!", "not good", "not a very good", "not one two three good", "don’t say good",
              "never not good", "not bad good", "very one good", "slightly bad", "very", "not", "", None, "very awful"]
    found = [p for p, _ in scores(spark, lexicon, bodies)]
    expected = [0.7, 0.91, 1.0, -0.35, -0.455, 0.7, -0.35, 0.7, 0.525, 0.7, -0.35, 0.0, 0.0, 0.0, 0.0, -1.0]
    assert found == pytest.approx(expected)


@pytest.mark.parametrize("lexicon_rows", [features.LEXICON_ROWS, 1])
def test_equals_word_by_word(spark, lexicon, lexicon_rows):
    chance = random.Random(8)
    vocabulary = [*LEXICON, "never", "isn't", "a", "b", "(good)", "NOT,", "--"]
    bodies = [" ".join(chance.choices(vocabulary, k=chance.randrange(0, 30))) for _ in range(150)]
    bodies += [None, "", " ".join(chance.choices(vocabulary, k=20_000))]
    found = scores(spark, lexicon, bodies, lexicon_rows=lexicon_rows)
    for body, pair in zip(bodies, found):
        assert pair == pytest.approx(brute(body)), (body or "")[:200]


def test_empty_tables(spark, lexicon):
    rows = spark.createDataFrame([(1, "very good")], "id int, headline string")
    assert features.context_scores(rows.limit(0), "id", ["headline"], lexicon).count() == 0
    assert features.context_scores(rows, "id", ["headline"], lexicon.limit(0)).first()["headline_sentiment"] == 0.0
