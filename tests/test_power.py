from __future__ import annotations

import math

import pytest

from pulse.operators import scaling


def test_power_leaves_out_nan_and_null(spark):
    values = [math.exp(i / 10) - 1 for i in range(40)]
    plain = spark.createDataFrame([(v,) for v in values], "x double")
    mixed = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "x double")
    assert scaling.fit_power(mixed, "x").power == pytest.approx(scaling.fit_power(plain, "x").power, abs=1e-6)


def test_power_raises_when_it_does_not_converge(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    with pytest.raises(ValueError):
        scaling.fit_power(frame, "x", rounds=1)
