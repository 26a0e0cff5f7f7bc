"""Quantiles by narrowing ranges and powers by Newton steps, against numpy and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators import quantiles, scaling

WANTED = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
chance = np.random.default_rng(5)
SHAPES = {
    "small integers": chance.integers(0, 10, 400).astype(float),
    "signs": np.round(chance.normal(0, 3, 500), 2),
    "hot value": np.where(np.arange(600) % 3 == 0, 7.25, chance.normal(7, 1, 600)),
    "every size": np.array([s * 10.0**e for s in (-1, 1) for e in range(-300, 301, 7)] + [0.0, -0.0]),
    "neighbours": np.nextafter(1.0, 2.0) + np.arange(50) * np.finfo(float).eps,
    "one": np.array([-3.5]),
}


def frame(spark, values):
    rows = [(float(v),) for v in values] + [(None,), (math.nan,)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "v double").repartition(5)


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_numpy(spark, shape):
    found = quantiles.exact_quantiles(frame(spark, SHAPES[shape]), {"v": WANTED})["v"]
    assert np.allclose(found, np.quantile(SHAPES[shape], WANTED), rtol=1e-12, atol=0)


def test_few_ranges_a_round_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANGES", 64)
    places = [float(p) for p in np.linspace(0, 1, 101)]
    found = quantiles.exact_quantiles(frame(spark, SHAPES["signs"]), {"v": places})["v"]
    assert np.allclose(found, np.quantile(SHAPES["signs"], places), rtol=1e-12)


def test_several_columns_at_once(spark):
    table = [(i, float(i) ** 3, None if i % 2 else float(-i)) for i in range(200)]
    rows = spark.createDataFrame(table, "v int, `odd name` double, c0 double").repartition(3)
    every = lambda n: [float(p) for p in np.linspace(0, 1, n)]
    found = quantiles.exact_quantiles(rows, {"v": [0.5], "odd name": every, "c0": [0.25, 0.5]})
    assert found["v"] == [99.5]
    assert np.allclose(found["odd name"], [float(i) ** 3 for i in range(200)])
    assert np.allclose(found["c0"], np.quantile([-float(i) for i in range(0, 200, 2)], [0.25, 0.5]))


def test_nothing_to_find(spark):
    rows = frame(spark, [])
    assert np.isnan(quantiles.exact_quantiles(rows, {"v": [0.5, 1.0]})["v"]).all()
    assert quantiles.exact_quantiles(rows.limit(0), {"v": []})["v"] == []
    assert quantiles.exact_quantiles(frame(spark, [1.0]), {"v": []})["v"] == []


def test_keys_keep_the_order(spark):
    values = np.sort(np.concatenate([SHAPES["every size"], SHAPES["signs"], [math.inf, -math.inf]]))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    found = rows.select("i", quantiles.ordered_key(F.col("v")).alias("key")).orderBy("i").collect()
    keys = [r["key"] % 2**64 for r in found]
    assert all((a < b) if x < y else (a == b) for a, b, x, y in zip(keys, keys[1:], values, values[1:]))


def test_no_order_and_one_small_shuffle(spark, monkeypatch):
    plans = []
    original = quantiles._count_parts

    def spied(df, searches):
        parts = original(df, searches)
        plans.append(parts._jdf.queryExecution().executedPlan().toString())
        return parts

    monkeypatch.setattr(quantiles, "_count_parts", spied)
    quantiles.exact_quantiles(frame(spark, SHAPES["signs"]), {"v": WANTED})
    assert 1 < len(plans) <= 5
    assert all(part not in p for p in plans for part in ("Window", "Sort", "Python", "Arrow", "NestedLoop"))


def test_scalers_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (None,)], "mean double").selectExpr("mean", "mean AS gradient")
    done = scaling.normalise(rows).collect()
    assert all(v is None for row in done for v in row)


def brute_power(values: np.ndarray) -> float:
    """Best power on ever finer grids."""

    def score(p: float) -> float:
        up, down = np.log1p(np.maximum(values, 0)), np.log1p(-np.minimum(values, 0))
        logs = (up - down).mean()
        if (values >= 0).all() or (values < 0).all():
            # The same up to a constant, without loss of digits far from 1.
            grown, logs = np.expm1((p if logs > 0 else 2 - p) * (up + down - abs(logs))) / (p if logs > 0 else 2 - p), 0.0
        else:
            grown = np.where(values >= 0, np.expm1(p * up) / p, -np.expm1((2 - p) * down) / (2 - p))
        spread = grown.var()
        return -math.log(spread) / 2 + p * logs if 0 < spread < math.inf else -math.inf

    center, reach = 0.0123, 200.0
    with np.errstate(all="ignore"):
        for _ in range(9):
            center = max((center + reach * i / 200 for i in range(-200, 201)), key=score)
            reach /= 20
    return center


@pytest.mark.parametrize(
    "values",
    [
        chance.exponential(3, 300),
        chance.normal(0, 2, 300) ** 3,
        10 - chance.exponential(1, 300),
        chance.lognormal(8, 3, 400),
        chance.normal(1000, 1, 300),
        chance.normal(-50, 4, 200),
        np.array([0.0, 0.0, 0.0, 1.0]),
    ],
    ids=["skewed", "cubes", "steep", "wide", "far", "negative", "ties"],
)
def test_power_equals_brute_force(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert scaling.fit_power(rows, "v").power == pytest.approx(brute_power(values), rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_far_powers_keep_their_digits(spark, sign):
    values = sign * (1000 + chance.normal(0, 1, 200) ** 2)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    model = scaling.fit_power(rows, "v")
    power, logs = (model.power if sign > 0 else 2 - model.power), np.log1p(np.abs(values))
    moved = sign * np.expm1(power * (logs - logs.mean())) / power
    found = np.array([r["s"] for r in model.transform(rows, "s").orderBy("i").collect()])
    assert abs(model.power) > 20 and np.allclose(found, (moved - moved.mean()) / moved.std(), atol=1e-6)


def test_values_of_the_other_sign(spark):
    """A column of one sign is scaled around its mean logarithm; other values follow the plain formula."""
    rows = spark.createDataFrame([(float(v),) for v in chance.exponential(3, 100)], "v double")
    model = scaling.fit_power(rows, "v")
    plain = rows.select(scaling.yeo_johnson("v", model.power).alias("y")).toPandas()["y"]
    others = spark.createDataFrame([(v,) for v in (-9.0, -0.5, 0.0, 2.0, 40.0)], "v double")
    found = [r["s"] for r in model.transform(others, "s").collect()]
    wanted = [r["y"] for r in others.select(scaling.yeo_johnson("v", model.power).alias("y")).collect()]
    assert np.allclose(found, (np.array(wanted) - plain.mean()) / plain.std(ddof=0))


def test_powers_of_several_columns(spark):
    first, second = chance.exponential(3, 200), chance.normal(0, 2, 200)
    table = [(float(a), float(b), 4.0, None) for a, b in zip(first, second)]
    rows = spark.createDataFrame(table, "a double, b double, same double, none double")
    together = scaling.fit_powers(rows, ["a", "b", "same", "none"])
    for column in ("a", "b"):
        assert together[column].power == pytest.approx(scaling.fit_power(rows, column).power, abs=1e-9)
    assert together["same"].power == 1.0 and together["same"].scaler.center == 4.0
    assert together["none"].power == 1.0


def test_power_copies_no_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 17),) for i in range(100)], "v double")
    plans = []
    original = type(rows).first
    monkeypatch.setattr(
        type(rows), "first", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(df)
    )
    scaling.fit_power(rows, "v")
    assert 3 <= len(plans) <= 15 and all("Generate" not in p for p in plans)
