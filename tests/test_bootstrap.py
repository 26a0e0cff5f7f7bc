"""Bootstrap intervals against a row-by-row version."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from pulse.operators import bootstrap


def weight(key: str, replicate: int) -> int:
    digest = hashlib.md5(key.encode()).hexdigest()
    seed = [int(digest[8 * i : 8 * i + 8], 16) % bootstrap.PRIME for i in range(4)]
    drawn = sum(s * replicate**i for i, s in enumerate(seed)) % bootstrap.PRIME
    total, times = 0.0, 0
    while times < 12:
        total += math.exp(-1) / math.factorial(times)
        if drawn < int(bootstrap.PRIME * total):
            break
        times += 1
    return times


def test_equals_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "GROUPS", 2)
    monkeypatch.setattr(bootstrap, "ROWS", 7)
    table = [(i, "hot" if i % 3 == 0 else None if i % 5 == 0 else f"g{i % 4}", i % 2, float(i * i % 37)) for i in range(120)]
    table += [(900, "hot", 0, None), (901, "hot", 1, math.nan), (902, "alone", 0, 5.0), (903, "empty", 0, None)]
    rows = spark.createDataFrame(table, "id long, name string, part int, v double").repartition(5)
    found = {(r["name"], r["part"]): r for r in bootstrap.bootstrap_means(rows, ["name", "part"], "v", ["id"], 60, 0.9).collect()}
    assert set(found) == {(name, part) for _, name, part, _ in table}
    for group, row in found.items():
        members = [(str(i), v) for i, name, part, v in table if (name, part) == group and v is not None and v == v]
        assert row["count"] == len(members)
        if not members:
            assert row["mean_v"] is row["low"] is row["high"] is None
            continue
        means = []
        for replicate in range(1, 61):
            drawn = [(weight(key, replicate), v) for key, v in members]
            if sum(w for w, _ in drawn):
                means.append(sum(w * v for w, v in drawn) / sum(w for w, _ in drawn))
        assert np.allclose([row["low"], row["high"]], np.quantile(means, [0.05, 0.95]))
    assert found["alone", 0]["low"] == found["alone", 0]["high"] == 5.0


def test_weights_have_mean_and_variance_one():
    seed = np.random.default_rng(2).integers(0, bootstrap.PRIME, (2000, 4))
    drawn = bootstrap.weights(seed, 200)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.1


def test_interval_has_the_width_of_the_theory(spark):
    values = np.random.default_rng(4).normal(10, 2, 2000)
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(values)], "id long, g string, v double")
    row = bootstrap.bootstrap_means(rows, ["g"], "v", ["id"], 400).first()
    assert row["high"] - row["low"] == pytest.approx(2 * 1.96 * values.std() / math.sqrt(2000), rel=0.15)


def test_empty_table_and_wrong_numbers(spark):
    rows = spark.createDataFrame([], "id long, g string, v double")
    assert bootstrap.bootstrap_means(rows, ["g"], "v", ["id"], 10).count() == 0
    with pytest.raises(ValueError):
        bootstrap.bootstrap_means(rows, ["g"], "v", ["id"], 0)


def test_rows_are_not_copied(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(50)], "id long, g int, v double")
    plan = bootstrap.bootstrap_means(rows, ["g"], "v", ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInPandas") and "NestedLoop" not in plan
