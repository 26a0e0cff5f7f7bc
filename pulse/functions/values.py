"""Numeric, list and vector expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def nan_to_zero(column: str | Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(_col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def clip_negative(column: str | Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(_col(column) < 0, F.lit(0)).otherwise(_col(column))


def change(now: str | Column, before: str | Column) -> Column:
    """Difference from the previous value; 0 on the first row."""
    return F.coalesce(_col(now) - _col(before), F.lit(0))


def relative_change(now: str | Column, before: str | Column, infinite: bool = False) -> Column:
    """Fraction by which a value grew; 0 on the first row.

    A zero base has no fraction: 0 by default, or signed infinity with
    ``infinite`` (0 after 0 stays 0 either way).
    """
    value, base = _col(now).cast("double"), _col(before).cast("double")
    growth = F.try_divide(value, base) - 1
    if infinite:
        endless = F.when(value > 0, F.lit(float("inf"))).when(value < 0, F.lit(float("-inf")))
        growth = F.when(base == 0, endless).otherwise(growth)
    return F.coalesce(growth, F.lit(0.0))


def reciprocal(column: str | Column) -> Column:
    """1 / x, with weight 0 for x = 0."""
    return F.coalesce(F.try_divide(F.lit(1.0), _col(column).cast("double")), F.lit(0.0))


def natural_log(column: str | Column) -> Column:
    """Natural logarithm; null at and below 0."""
    return F.ln(_col(column).cast("double"))


def bin4(column: str | Column, cuts: tuple[float, float, float]) -> Column:
    """``lowest``, ``low``, ``moderate`` or ``high`` by three upper bounds."""
    value = _col(column)
    return (
        F.when(value < cuts[0], "lowest").when(value < cuts[1], "low").when(value < cuts[2], "moderate").otherwise("high")
    )


def lookup(column: str | Column, mapping: dict) -> Column:
    """Value of a small fixed mapping, null for unknown keys."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), _col(column))


def labels_from_mask(labels: str | Column, mask: str | Column) -> Column:
    """Labels whose mask entry is true."""
    kept = F.filter(F.arrays_zip(_col(labels).alias("label"), _col(mask).alias("keep")), lambda x: x["keep"])
    return F.transform(kept, lambda x: x["label"])


def labels_by_score(labels: str | Column, scores: str | Column, k: int | None = None) -> Column:
    """Labels from highest to lowest score, ties in label order; the first ``k`` if given."""
    pairs = F.zip_with(_col(labels), _col(scores), lambda x, s: F.struct((-s).alias("s"), x.alias("x")))
    ordered = F.transform(F.array_sort(pairs), lambda p: p["x"])
    return ordered if k is None else F.slice(ordered, 1, k)


def first_of(labels: str | Column, priorities: Sequence[str]) -> Column:
    """First of ``priorities`` found in a list of labels."""
    if not priorities:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.array_contains(_col(labels), p), F.lit(p)) for p in priorities])


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def bucket(column: str | Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin from 1 to ``bins``; the upper edge belongs to the last bin."""
    if high <= low:
        return F.when(_col(column).isNotNull(), F.lit(1).cast("long"))
    return F.least(F.width_bucket(_col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))
