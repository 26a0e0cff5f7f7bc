"""All labels in one fit, and models that come back from disk."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulse.operators import models, multilabel, persist, scaling

TOPICS = {"sun": "warm bright sky", "wet": "rain storm cloud", "win": "match goal team", "law": "court judge vote"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        chosen = [t for t in TOPICS if rng.random() < 0.3]
        words = [w for t in chosen for w in rng.sample(TOPICS[t].split(), 2)] + rng.choices("the a of in and old new day".split(), k=6)
        rows.append((i, " ".join(words), [*chosen, "all"] if i % 9 else [*chosen, "all", None, "unlisted"]))
    frame = spark.createDataFrame(rows, "id long, headline string, themes array<string>")
    return models.embed(frame, "headline", models.HashingEncoder.fit(frame, "headline", 64)).repartition(3).cache()


NAMES = [*TOPICS, "all", "never"]


def test_one_fit_suggests_what_one_fit_per_label_does(labelled):
    together = models.LabelSuggester.fit(labelled, "themes", NAMES, rounds=100).transform(labelled, "suggested")
    got = {r.id: r.suggested for r in together.collect()}
    alone = {i: [] for i in got}
    for name in NAMES:
        rows = labelled.withColumn("y", F.array_contains("themes", name).cast("double")).fillna(0.0, ["y"])
        learner = LogisticRegression(featuresCol="vector", labelCol="y", maxIter=100, regParam=0.01)
        for r in learner.fit(rows).transform(rows).select("id", (vector_to_array("probability")[1] > 0.5).alias("is")).collect():
            alone[r.id] += [name] if r["is"] else []
    assert got == alone
    assert all("all" in x and "never" not in x for x in got.values())


def test_weights_are_those_of_the_usual_learner(labelled):
    weights, offsets = multilabel.fit(labelled.withColumn("v", vector_to_array("vector")), "themes", ["sun", "law"], "v", 200, 0.01)
    for w, b, name in zip(weights, offsets, ["sun", "law"]):
        rows = labelled.withColumn("y", F.coalesce(F.array_contains("themes", name), F.lit(False)).cast("double"))
        model = LogisticRegression(featuresCol="vector", labelCol="y", maxIter=200, regParam=0.01, tol=1e-10).fit(rows)
        assert np.allclose(w, model.coefficients.toArray(), atol=0.02) and b == pytest.approx(model.intercept, abs=0.02)


def test_jobs_do_not_grow_with_the_labels(spark, labelled, monkeypatch):
    monkeypatch.setattr(multilabel, "TOLERANCE", 0.0)
    counts = []
    for names in (["sun"], NAMES):
        spark.sparkContext.setJobGroup(f"fit {len(names)}", "")
        models.LabelSuggester.fit(labelled, "themes", names, rounds=3)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {len(names)}")))
    spark.sparkContext.setJobGroup("other", "")
    # A step that must be halved costs one more pass for all labels together.
    assert counts[1] <= counts[0] + 2 * 3


def test_odd_inputs(spark, labelled, monkeypatch):
    none = models.LabelSuggester.fit(labelled.limit(0), "themes", NAMES)
    assert {tuple(r.s) for r in none.transform(labelled, "s").collect()} == {()}
    assert {tuple(r.s) for r in models.LabelSuggester.fit(labelled, "themes", []).transform(labelled, "s").collect()} == {()}
    monkeypatch.setattr(multilabel, "LARGEST", 10)
    with pytest.raises(ValueError):
        models.LabelSuggester.fit(labelled, "themes", NAMES)


def test_models_come_back_in_another_session(spark, labelled, tmp_path):
    plain = labelled.select("id", "headline", "themes")
    numbers = labelled.select("id", "vector", F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("label"))
    ranked = labelled.withColumn("label", F.element_at("themes", 1))
    made = {
        "encoder": (models.HashingEncoder.fit(plain, "headline", 32), lambda m: models.as_array(m.transform(plain, "headline"))),
        "suggester": (models.LabelSuggester.fit(labelled, "themes", NAMES), lambda m: m.transform(labelled, "s").select("id", "s")),
        "ranker": (models.train_labels(ranked, rounds=3), lambda m: models.ranked_labels(ranked, m).select("id", "suggested_labels")),
        "fusion": (models.fusion_classifier(numbers, ["x"], hidden=4, rounds=3), lambda m: m.transform(numbers).select("id", "pred_y")),
        "scaler": (scaling.fit_scaler(numbers, "x", "standard"), lambda m: m.transform(numbers).select("id", "x")),
        "bounds": (scaling.MinMaxModel.fit(numbers, ["x"]), lambda m: m.transform(numbers).select("id", "x")),
        "power": (scaling.fit_power(numbers, "x"), lambda m: m.transform(numbers, "y").select("id", "y")),
        "quantiles": (scaling.fit_quantiles(numbers, "x"), lambda m: m.transform(numbers, "y").select("id", "y")),
    }
    for name, (model, use) in made.items():
        for _ in range(2):  # a second save replaces the first
            persist.save(model, str(tmp_path / name))
        other = persist.load(spark.newSession(), str(tmp_path / name))
        assert type(other) is type(model)
        assert sorted(map(str, use(other).collect())) == sorted(map(str, use(model).collect())), name


def test_fit_reads_blocks_without_zeros(spark):
    """Passes read the numbers that are not zero, once packed, and get the same features and marks from them."""
    table = [([0.0] * 40 + [float(i), 0.0], [i % 2] if i % 3 else []) for i in range(300)]
    rows = spark.createDataFrame(table, "vector array<double>, marks array<int>").coalesce(1)
    blocks = multilabel._packed(rows, 2)
    assert blocks.count() == 2
    assert blocks.selectExpr("sum(length(numbers))").first()[0] == 8 * 299
    pairs = [pair for batch in blocks.toArrow().to_batches() for pair in multilabel._blocks(batch, 2)]
    assert np.concatenate([x for x, _ in pairs]).tolist() == [v for v, _ in table]
    assert np.concatenate([y for _, y in pairs]).tolist() == [[float(k in m) for k in (0, 1)] for _, m in table]
