"""Scalers: fit one row of statistics on a frame, apply it to any frame as a projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import values
from pulse.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class ScalerModel:
    """Subtract ``center``, divide by ``spread``; a constant column becomes its offset, 0."""

    column: str
    center: float
    spread: float

    def expression(self, column: str | None = None) -> Column:
        source = F.col(column or self.column).cast("double")
        return (source - F.lit(self.center)) / F.lit(self.spread or 1.0)

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        return df.withColumn(output or self.column, self.expression())


def fit_scaler(df: DataFrame, column: str, kind: str) -> ScalerModel:
    """``standard`` (population deviation), ``minmax`` or ``robust`` (median and quartile range)."""
    value = F.col(column).cast("double")
    if kind == "standard":
        center, spread = df.agg(F.avg(value), F.stddev_pop(value)).first()
    elif kind == "minmax":
        center, high = df.agg(F.min(value), F.max(value)).first()
        spread = None if high is None else high - center
    elif kind == "robust":
        low, center, high = exact_quantiles(df, {column: [0.25, 0.5, 0.75]})[column]
        # A column without values has no quartiles and becomes null whatever the constants.
        center, spread = (0.0, 0.0) if math.isnan(center) else (center, high - low)
    else:
        raise ValueError(f"unknown scaler: {kind}")
    return ScalerModel(column, center or 0.0, spread or 0.0)


def scale(df: DataFrame, column: str, kind: str, output: str) -> DataFrame:
    """Fit and apply one of the scalers, or the natural logarithm."""
    if kind == "log":
        return df.withColumn(output, values.natural_log(column))
    return fit_scaler(df, column, kind).transform(df, output)


@dataclass(frozen=True)
class MinMaxModel:
    """Min-max scaling of several columns with the bounds of the frame it was fitted on."""

    bounds: dict[str, ScalerModel]

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> MinMaxModel:
        ends = train.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
        models = {}
        for place, column in enumerate(columns):
            low, high = ends[2 * place], ends[2 * place + 1]
            models[column] = ScalerModel(column, low or 0.0, (high - low) if low is not None else 0.0)
        return MinMaxModel(models)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: model.expression() for c, model in self.bounds.items()})


def yeo_johnson(column: str | Column, power: float | Column) -> Column:
    """Yeo-Johnson transform of a column for a given power."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    power = power if isinstance(power, Column) else F.lit(float(power))

    def boxed(base: Column, exponent: Column) -> Column:
        # Logarithm at exponent 0; elsewhere (base^exponent - 1) / exponent.
        flat = F.abs(exponent) < 1e-12
        return F.when(flat, F.ln(base)).otherwise(F.try_divide(F.pow(base, exponent) - 1, exponent))

    return F.when(x >= 0, boxed(x + 1, power)).otherwise(-boxed(1 - x, 2 - power))


def _growth(t: Column) -> tuple[Column, Column, Column]:
    """``(e^t - 1) / t`` and its first two derivatives; by their series near 0, where the quotients lose digits."""

    def series(terms: list[float]) -> Column:
        total = F.lit(terms[-1])
        for term in reversed(terms[:-1]):
            total = total * t + F.lit(term)
        return total

    order = range(16)
    near = [
        series([1 / math.factorial(k + 1) for k in order]),
        series([(k + 1) / math.factorial(k + 2) for k in order]),
        series([(k + 2) * (k + 1) / math.factorial(k + 3) for k in order]),
    ]
    grown = F.exp(t)
    far = [
        F.try_divide(F.expm1(t), t),
        F.try_divide(grown * (t - 1) + 1, t * t),
        F.try_divide(grown * (t * t - 2 * t + 2) - 2, t * t * t),
    ]
    first, second, third = (F.when(F.abs(t) < 1, a).otherwise(b) for a, b in zip(near, far))
    return first, second, third


@dataclass(frozen=True)
class PowerModel:
    """Yeo-Johnson power with the mean and deviation of the transformed column.

    ``shift`` is the mean logarithm of a column with values of one sign (below 0 for
    negative ones), else 0. The transform is then taken around it, which changes the
    scaled values by nothing but rounding: powers far from 1 keep their digits.
    """

    column: str
    power: float
    scaler: ScalerModel
    shift: float = 0.0

    def moved(self) -> Column:
        x = F.col(self.column).cast("double")
        plain = yeo_johnson(x, self.power)
        if not self.shift:
            return plain
        side, around = math.copysign(1.0, self.shift), abs(self.shift)
        power = self.power if side > 0 else 2 - self.power
        gap = F.log1p(F.abs(x)) - around
        near = side * gap * _growth(power * gap)[0]
        # Values of the other sign, which the fit has not seen, go on from there.
        stretch = F.exp(F.lit(power * around))
        start = side * around * _growth(F.lit(power * around))[0]
        return F.when(x >= 0 if side > 0 else x < 0, near).otherwise(F.try_divide(plain - start, stretch))

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, (self.moved() - F.lit(self.scaler.center)) / F.lit(self.scaler.spread or 1.0))


@dataclass
class _PowerSearch:
    """Newton steps towards the power of one column, kept between the powers known to be too low and too high."""

    power: float = 1.0
    low: float = -math.inf
    high: float = math.inf
    #: Last power with finite derivatives, and how far to go while one side is open.
    safe: float = 1.0
    reach: float = 1.0
    done: bool = False

    def step(self, slope: float, bend: float) -> None:
        """Move on by the first and second derivative of the likelihood."""
        here = self.power
        if not (math.isfinite(slope) and math.isfinite(bend)):
            if here == self.safe:
                raise ValueError("no power gives a finite likelihood")
            self.low, self.high = (self.low, here) if here > self.safe else (here, self.high)
            self.power = (here + self.safe) / 2
            return
        self.safe = here
        self.low, self.high = (here, self.high) if slope > 0 else (self.low, here)
        goal = here - slope / bend if bend < 0 else math.nan
        # Nothing to gain but rounding: half the slope times the step, per row.
        if slope == 0 or slope * (goal - here) / 2 <= 1e-13:
            self.power, self.done = (here if slope == 0 else goal), True
            return
        if not self.low < goal < self.high:
            if math.isfinite(self.low) and math.isfinite(self.high):
                goal = (self.low + self.high) / 2
            else:
                goal = here + math.copysign(self.reach, slope)
                self.reach *= 2
        self.power = goal


def fit_powers(df: DataFrame, columns: Sequence[str], rounds: int = 60) -> dict[str, PowerModel]:
    """Find the power of each column with the highest likelihood, then standardise.

    Newton's method: one aggregation per step gives the variance of the transformed
    values of all columns and its first two derivatives; a step that leaves the
    interval known to hold the optimum is replaced by its middle. No row is copied and
    four numbers per column come back. Nulls and NaN are left out; a constant or empty
    column keeps the power 1. A search that ends without an optimum raises ``ValueError``.
    """
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    value = {c: F.col(c).cast("double") for c in columns}
    rows = df.select(*[F.when(~F.isnan(value[c]), value[c]).alias(n) for c, n in names.items()])
    log = lambda x: F.avg(F.signum(x) * F.log1p(F.abs(x)))
    first = rows.agg(*[f(F.col(n)) for n in names.values() for f in (F.avg, F.var_pop, log, F.min, F.max)]).first()
    means, logs, shifts, searches = {}, {}, {}, {}
    for i, c in enumerate(columns):
        means[c], spread, logs[c], low, high = first[5 * i : 5 * i + 5]
        if spread:
            searches[c] = _PowerSearch()
            # Around the mean logarithm its term leaves the likelihood.
            shifts[c], logs[c] = (logs[c], 0.0) if low >= 0 or high < 0 else (0.0, logs[c])

    def terms(c: str) -> Column:
        x, power = F.col(names[c]), F.lit(searches[c].power)
        length, side = F.log1p(F.abs(x)) - abs(shifts[c]), F.when(x >= 0, 1.0).otherwise(-1.0)
        plain, once, twice = _growth(F.when(x >= 0, power).otherwise(2 - power) * length)
        return F.struct(
            (side * length * plain).alias("y"),
            (length * length * once).alias("d"),
            (side * length * length * length * twice).alias("e"),
        )

    for _ in range(rounds):
        active = [c for c, s in searches.items() if not s.done]
        if not active:
            break
        moved = rows.select(*[F.when(F.col(names[c]).isNotNull(), terms(c)).alias(names[c]) for c in active])
        wanted = []
        for c in active:
            y, d, e = (F.col(f"{names[c]}.{part}") for part in "yde")
            wanted += [F.var_pop(y), F.covar_pop(y, d), F.var_pop(d), F.covar_pop(y, e)]
        found = moved.agg(*wanted).first()
        for i, c in enumerate(active):
            spread, tilt, inner, outer = found[4 * i : 4 * i + 4]
            if not spread or not math.isfinite(spread):
                searches[c].step(math.nan, math.nan)
                continue
            rate = 2 * tilt / spread
            searches[c].step(logs[c] - rate / 2, -(2 * (inner + outer) / spread - rate * rate) / 2)
    unsettled = [c for c, s in searches.items() if not s.done]
    if unsettled:
        raise ValueError(f"the search for the power of {', '.join(unsettled)} did not converge")
    models = {c: PowerModel(c, 1.0, ScalerModel(c, means[c] or 0.0, 0.0)) for c in columns if c not in searches}
    if searches:
        moved = {c: PowerModel(names[c], s.power, ScalerModel(c, 0.0, 1.0), shifts[c]).moved() for c, s in searches.items()}
        final = rows.agg(*[f(y) for y in moved.values() for f in (F.avg, F.stddev_pop)]).first()
        for i, (c, s) in enumerate(searches.items()):
            models[c] = PowerModel(c, s.power, ScalerModel(c, final[2 * i], final[2 * i + 1]), shifts[c])
    return models


def fit_power(df: DataFrame, column: str, rounds: int = 60) -> PowerModel:
    """The power of one column, see ``fit_powers``."""
    return fit_powers(df, [column], rounds)[column]


@dataclass(frozen=True)
class QuantileModel:
    """Position of a value between up to 1000 quantiles, as a number from 0 to 1."""

    column: str
    quantiles: list[float] = field(repr=False)

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        marks = np.asarray(self.quantiles)
        places = np.linspace(0, 1, len(marks))

        @F.pandas_udf("double")
        def position(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = batch.to_numpy(dtype="float64", na_value=np.nan)
                # Equal quantiles give a value the middle of their places.
                up = np.interp(x, marks, places)
                down = -np.interp(-x, -marks[::-1], -places[::-1])
                yield pd.Series(np.where(np.isnan(x), np.nan, (up + down) / 2))

        return df.withColumn(output, position(F.col(self.column).cast("double")))


def _marks(most: int) -> Callable[[int], list[float]]:
    """Evenly spaced probabilities, at most one per value."""
    return lambda rows: [float(p) for p in np.linspace(0, 1, max(1, min(most, rows)))]


def fit_quantiles(df: DataFrame, column: str, most: int = 1000) -> QuantileModel:
    """Up to ``most`` evenly spaced exact quantiles of the whole column."""
    return QuantileModel(column, exact_quantiles(df, {column: _marks(most)})[column])


def normalise(df: DataFrame, columns: tuple[str, ...] = ("mean", "gradient")) -> DataFrame:
    """Add every scaled form of the columns.

    Means, deviations and ends of all columns come from one pass; quartiles and
    quantiles, and the powers, from a few passes over all columns. ``df`` is read
    several times, so settle it first.
    """
    statistics = (F.avg, F.stddev_pop, F.min, F.max)
    row = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in statistics]).first()
    marks = exact_quantiles(df, {c: lambda rows: [*_marks(1000)(rows), 0.25, 0.5, 0.75] for c in columns})
    powers = fit_powers(df, columns)
    added: dict[str, Column] = {}
    result = df
    for place, column in enumerate(columns):
        mean, spread, low, high = row[4 * place : 4 * place + 4]
        *spots, first, middle, third = marks[column]
        added[f"{column}_s_scaled"] = ScalerModel(column, mean or 0.0, spread or 0.0).expression()
        added[f"{column}_mm_scaled"] = ScalerModel(column, low or 0.0, (high - low) if low is not None else 0.0).expression()
        added[f"{column}_r_scaled"] = ScalerModel(column, middle, third - first).expression()
        added[f"{column}_log"] = values.natural_log(column)
        result = powers[column].transform(result, f"{column}_pt_scaled")
        result = QuantileModel(column, spots).transform(result, f"{column}_qt_scaled")
    return result.withColumns(added)
