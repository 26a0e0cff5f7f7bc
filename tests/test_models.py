"""Fits and rankings against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators import labelling, models, scaling, similarity
from pulse.plans.checks import adapters


def likelihood(values: np.ndarray, power: float) -> float:
    def boxed(base, exponent):
        return np.log(base) if abs(exponent) < 1e-12 else (base**exponent - 1) / exponent

    moved = np.where(values >= 0, boxed(np.maximum(values, 0) + 1, power), -boxed(1 - np.minimum(values, 0), 2 - power))
    return -len(values) / 2 * math.log(moved.var()) + (power - 1) * (np.sign(values) * np.log1p(np.abs(values))).sum()


@pytest.mark.parametrize("shape", ["skewed", "mixed", "steep"])
def test_power_has_the_highest_likelihood(spark, shape):
    chance = np.random.default_rng(1)
    drawn = {
        "skewed": chance.exponential(3, 300),
        "mixed": chance.normal(0, 2, 300) ** 3,
        "steep": 10 - chance.exponential(1, 300),
    }[shape]
    rows = spark.createDataFrame([(float(v),) for v in drawn], "v double")
    model = scaling.fit_power(rows, "v")
    best = likelihood(drawn, model.power)
    assert all(best >= likelihood(drawn, model.power + step) for step in (-0.5, -0.01, -1e-4, 1e-4, 0.01, 0.5))
    scaled = np.array([r["s"] for r in model.transform(rows, "s").collect()])
    assert abs(scaled.mean()) < 1e-9 and abs(scaled.std() - 1) < 1e-9


def test_power_of_a_constant(spark):
    rows = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert {r["s"] for r in scaling.fit_power(rows, "v").transform(rows, "s").collect()} == {0.0}


@pytest.mark.parametrize("rows", [50, 3000])
def test_quantile_transform(spark, rows):
    drawn = np.round(np.random.default_rng(2).normal(0, 1, rows), 1)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(drawn)], "i int, v double")
    model = scaling.fit_quantiles(frame, "v")
    places = np.linspace(0, 1, min(1000, rows))
    marks = np.quantile(drawn, places)
    assert np.allclose(model.quantiles, marks)
    expected = (np.interp(drawn, marks, places) - np.interp(-drawn, -marks[::-1], -places[::-1])) / 2
    found = [r["s"] for r in model.transform(frame, "s").orderBy("i").collect()]
    assert np.allclose(found, expected)
    outside = spark.createDataFrame([(-99.0,), (99.0,), (None,)], "v double")
    assert [r["s"] for r in model.transform(outside, "s").collect()][:2] == [0.0, 1.0]


def test_normalise_equals_the_single_scalers(spark):
    drawn = np.random.default_rng(3).exponential(5, 200)
    rows = spark.createDataFrame([(float(v), float(v**2)) for v in drawn], "mean double, gradient double")
    done = scaling.normalise(rows)
    assert set(done.columns) == {"mean", "gradient"} | {
        f"{c}_{s}" for c in ("mean", "gradient") for s in ("s_scaled", "mm_scaled", "r_scaled", "pt_scaled", "qt_scaled", "log")
    }
    for kind, name in (("standard", "s_scaled"), ("minmax", "mm_scaled"), ("robust", "r_scaled")):
        alone = scaling.fit_scaler(rows, "gradient", kind).expression("gradient")
        gap = done.select(F.max(F.abs(F.col(f"gradient_{name}") - alone))).first()[0]
        assert gap < 1e-9


def chain(vectors: dict, interactions: dict) -> list:
    """Row by row, as described: rank the most alike, move on to the second."""
    unit = {k: v / np.linalg.norm(v) for k, v in vectors.items()}
    left = sorted(vectors, key=lambda k: (-interactions[k], k))
    reference = unit[left[0]]
    ranked = []
    while left:
        alike = sorted(left, key=lambda k: (-float(unit[k] @ reference), left.index(k)))
        ranked.append(alike[0])
        if len(alike) > 1:
            reference = unit[alike[1]]
        left.remove(alike[0])
    return ranked


def test_chain_against_brute_force(spark, data):
    rows = adapters.vectors(spark, data)
    done = similarity.similarity_chain(rows, "label", "vec_id").collect()
    table = rows.collect()
    for label in {r["label"] for r in table}:
        part = [r for r in table if r["label"] == label]
        expected = chain(
            {r["vec_id"]: np.array(r["vector"], dtype=float) for r in part},
            {r["vec_id"]: r["facebook_interactions"] for r in part},
        )
        found = [r["vec_id"] for r in sorted((r for r in done if r["label"] == label), key=lambda r: r["similarity_rank"])]
        assert found == expected


def test_large_groups_are_chained_step_by_step(spark):
    chance = np.random.default_rng(5)
    table = [("big" if i < 7 else "small", i, int(chance.integers(5)), chance.normal(0, 1, 4).tolist()) for i in range(10)]
    rows = spark.createDataFrame(table, "g string, id long, facebook_interactions long, vector array<double>")
    whole = similarity.similarity_chain(rows, "g", "id")
    steps = similarity.similarity_chain(rows, "g", "id", chain_rows=5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, steps.collect()))


def test_seed_ranking_is_a_permutation(spark, data):
    rows = adapters.vectors(spark, data)
    seed = similarity.top_article(rows, "vec_id")
    plain = similarity.similarity_to_seed(rows, seed, "vec_id").select("vec_id", "similarity_rank")
    sliced = similarity.similarity_to_seed(rows, seed, "vec_id", hot_rows=100).select("vec_id", "similarity_rank")
    found = sorted(map(tuple, plain.collect()))
    assert found == sorted(map(tuple, sliced.collect()))
    assert sorted(rank for _, rank in found) == list(range(len(found)))


def test_split_is_stable_and_whole(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "id long, s string")
    first = models.stratified_split(rows, "s", "id", 0.2, 0.25)
    again = models.stratified_split(rows.repartition(7), "s", "id", 0.2, 0.25, hot_rows=10)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    sizes = {(r["s"], r["split"]): r["count"] for r in first.groupBy("s", "split").count().collect()}
    assert sizes == {
        ("a", "test"): 12,
        ("a", "validation"): 12,
        ("a", "train"): 36,
        ("b", "test"): 6,
        ("b", "validation"): 6,
        ("b", "train"): 18,
    }
    other = models.stratified_split(rows, "s", "id", 0.2, 0.25, seed=1)
    assert sorted(map(tuple, first.collect())) != sorted(map(tuple, other.collect()))


def test_split_cuts_through_repeated_keys(spark):
    """Keys that repeat, null ones included, are split to the row, in any number of slices."""
    table = [(None if i < 40 else i // 7, "a" if i % 3 else None, str(i)) for i in range(200)]
    rows = spark.createDataFrame(table, "id long, s string, t string")
    first = models.stratified_split(rows, "s", "id", 0.2, 0.25)
    again = models.stratified_split(rows.repartition(7), "s", "id", 0.2, 0.25, hot_rows=10)
    key = lambda r: tuple(str(v) for v in r)
    assert first.columns == ["id", "s", "t", "split"]
    assert sorted(map(tuple, first.collect()), key=key) == sorted(map(tuple, again.collect()), key=key)
    sizes = {(r["s"], r["split"]): r["count"] for r in first.groupBy("s", "split").count().collect()}
    for name in ("a", None):
        n = sum(s == name for _, s, _ in table)
        test = int(n * 0.2 + 0.5)
        assert (sizes[name, "test"], sizes[name, "validation"]) == (test, int((n - test) * 0.25 + 0.5))
    assert sorted(r["t"] for r in first.collect()) == sorted(t for _, _, t in table)


def test_labels_are_learned(spark):
    table = [(i, "good fine day" if i % 2 else "bad rain storm", [["sun"], ["wet"]][i % 2 == 0]) for i in range(40)]
    rows = spark.createDataFrame(table, "id long, headline string, themes array<string>")
    encoder = models.HashingEncoder.fit(rows, "headline", 64)
    vectors = models.embed(rows, "headline", encoder)
    suggester = models.LabelSuggester.fit(vectors, "themes", ["sun", "wet"])
    done = models.suggest_labels(vectors, suggester, "suggested").collect()
    assert all(r["suggested"] == r["themes"] for r in done)
    assert "suggested" not in models.suggest_labels(vectors, None, "suggested").columns
    labelled = vectors.withColumn("label", F.element_at("themes", 1))
    model = models.train_labels(labelled)
    ranked = models.ranked_labels(labelled, model).collect()
    assert all(r["suggested_labels"][0] == r["label"] and len(r["suggested_labels"]) == 2 for r in ranked)


def test_encoder_from_a_function(spark):
    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    rows = spark.createDataFrame([("banana",), (None,)], "t string")
    done = models.as_array(models.embed(rows, "t", models.FunctionEncoder(load))).collect()
    assert [r["vector"] for r in done] == [[6.0, 3.0], [0.0, 0.0]]


def test_fusion_of_text_and_numbers(spark):
    table = [(f"word{i % 3}", float(i % 3), i % 3) for i in range(60)]
    rows = spark.createDataFrame(table, "headline string, n double, label int")
    vectors = models.embed(rows, "headline", models.HashingEncoder.fit(rows, "headline", 16))
    model = models.fusion_classifier(vectors, ["n"], hidden=8)
    assert all(r["label"] == r["pred_y"] for r in model.transform(vectors).collect())


def test_single_day_projection_is_flat(spark):
    rows = spark.createDataFrame([("i", 1, 5.0)], "article_index string, day long, facebook_interactions double")
    assert [r["forecast"] for r in labelling.project_index(rows, 2).collect()] == [5.0, 5.0]


def test_label_queries_run_the_whole_job(spark, data, monkeypatch):
    """Default rounds, every theme and index of the labels table, all numeric features."""
    from pulse.plans.checks import learning

    seen = []

    def spy(owner, name, wrap):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, wrap(lambda *args, **more: (seen.append((name, args, more)), real(*args, **more))[1]))

    spy(models.LabelSuggester, "fit", staticmethod)
    spy(models, "train_labels", lambda f: f)
    spy(models, "fusion_classifier", lambda f: f)
    row = learning.suggest_labels(spark, data).first()
    assert {"suggested", "suggested_indexes"} < set(row.asDict())
    for query in (learning.train_labels, learning.fusion_classifier):
        assert query(spark, data).count() > 0
    assert not any("rounds" in more for _, _, more in seen)
    names = {args[1]: set(args[2]) for name, args, _ in seen if name == "fit"}
    for kind in ("themes", "indexes"):
        assert names[kind] == {x for r in adapters.labels(spark, data).collect() for x in r[kind]}
    assert "toxic" in names["themes"]
    assert len(next(args[1] for name, args, _ in seen if name == "fusion_classifier")) == 19
