"""Exact quantiles of several columns by narrowing ranges of values; nothing is sorted or shuffled by value."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranges of values counted per column and round, so also the most rows a round brings back per column.
RANGES = 1 << 17
# Sign, exponent and the first four binary digits: the ranges of the first round.
FIRST_BITS = 16

Probabilities = Sequence[float] | Callable[[int], Sequence[float]]


def ordered_key(value: Column) -> Column:
    """A 64-bit key of a double; read as an unsigned number it keeps the order of the doubles."""
    plain = F.when(value == 0, 0.0).otherwise(value)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits >= 0, bits.bitwiseXOR(F.lit(-(2**63)).cast("long"))).otherwise(F.bitwise_not(bits))


@dataclass
class _Search:
    """What is known of one column: open ranges of values, each a prefix of the keys inside it."""

    probabilities: Probabilities
    depth: int = 0
    bits: int = FIRST_BITS
    prefixes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    #: Rows below each open range, and the ranks to find in it.
    below: list[int] = field(default_factory=lambda: [0])
    ranks: list[list[int]] | None = None
    spots: list[float] = field(default_factory=list)
    found: dict[int, float] = field(default_factory=dict)

    def narrow(self, counted: pd.DataFrame) -> None:
        """Go on with the parts that hold a wanted rank and more than one value."""
        counted = counted.sort_values("slot")
        slot, rows = counted["slot"].to_numpy(), counted["rows"].to_numpy()
        low, high = counted["low"].to_numpy(), counted["high"].to_numpy()
        if self.ranks is None:
            total = int(rows.sum())
            chosen = self.probabilities(total) if callable(self.probabilities) else self.probabilities
            self.spots = [p * (total - 1) for p in chosen] if total else [math.nan] * len(chosen)
            self.ranks = [sorted({r for s in self.spots for r in (math.floor(s), math.ceil(s))})] if total else [[]]
        prefixes, below, ranks = [], [], []
        starts = np.searchsorted(slot, np.arange(len(self.prefixes) + 1) << self.bits)
        for place, wanted in enumerate(self.ranks):
            here = slice(starts[place], starts[place + 1])
            upto = self.below[place] + np.cumsum(rows[here])
            for rank in wanted:
                at = int(np.searchsorted(upto, rank, side="right"))
                row = here.start + at
                if low[row] == high[row]:
                    self.found[rank] = float(low[row])
                    continue
                part = (int(self.prefixes[place]) << self.bits) | (int(slot[row]) & ((1 << self.bits) - 1))
                if not prefixes or prefixes[-1] != part:
                    prefixes.append(part)
                    below.append(int(upto[at] - rows[row]))
                    ranks.append([])
                ranks[-1].append(rank)
        self.prefixes, self.below, self.ranks = np.array(prefixes, np.uint64), below, ranks
        self.depth += self.bits
        room = max(4, int(math.log2(RANGES / max(1, len(prefixes)))))
        self.bits = min(room, 64 - self.depth)

    @property
    def open(self) -> bool:
        return len(self.prefixes) > 0

    def results(self) -> list[float]:
        out = []
        for spot in self.spots:
            if math.isnan(spot):
                out.append(spot)
                continue
            low, high = self.found[math.floor(spot)], self.found[math.ceil(spot)]
            out.append(low if low == high else low + (high - low) * (spot - math.floor(spot)))
        return out


def _count_parts(df: DataFrame, searches: Mapping[str, _Search]) -> DataFrame:
    """Rows, smallest and largest value per column and part; tasks sum before the shuffle."""
    cells = [F.struct(F.lit(i).alias("place"), F.col(c).alias("value")) for i, c in enumerate(searches)]
    values = df.select(F.inline(F.array(*cells))).where("value IS NOT NULL AND NOT isnan(value)")
    keyed = values.withColumn("key", ordered_key(F.col("value")))

    def by_column(number: Callable[[_Search], int]) -> str:
        return f"CASE {' '.join(f'WHEN place = {i} THEN {number(s)}' for i, s in enumerate(searches.values()))} END"

    if all(s.depth for s in searches.values()):
        listed = [(i, int(p), n) for i, s in enumerate(searches.values()) for n, p in enumerate(s.prefixes)]
        ranges = df.sparkSession.createDataFrame(listed, "place int, prefix bigint, number bigint")
        top = F.expr(f"shiftrightunsigned(key, {by_column(lambda s: 64 - s.depth)})")
        # One row per open range: at most two per wanted rank.
        keyed = keyed.withColumn("prefix", top).join(F.broadcast(ranges), ["place", "prefix"])
    else:
        keyed = keyed.withColumn("number", F.lit(0).cast("long"))
    bits, rest = by_column(lambda s: s.bits), by_column(lambda s: 64 - s.depth - s.bits)
    slot = F.expr(f"shiftleft(number, {bits}) | (shiftrightunsigned(key, {rest}) & (shiftleft(1L, {bits}) - 1L))")
    return keyed.groupBy("place", slot.alias("slot")).agg(
        F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Probabilities]) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation of several columns.

    ``wanted`` gives each column its probabilities, or a function from the number of
    its values to them. Doubles are taken as 64-bit keys of the same order. A round is one
    pass over all columns: it splits every range that holds a wanted rank and more
    than one value into parts of equal key width and counts their rows. The number of
    rounds depends on the digits of the values, not on their number or distribution:
    four to ten at most, two to four for usual columns. A round counts, and brings
    back, at most ``RANGES`` ranges per column (16 for each wanted rank if that is more).

    Nulls and NaN are left out; a column without values gives NaN. A value that a
    third of all rows share is one part, found in the round that isolates it. ``df``
    is read once per round, so settle it first if it is costly.
    """
    searches = {f"c{i}": _Search(p) for i, p in enumerate(wanted.values())}
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(wanted)])
    active = searches
    while active:
        counted = _count_parts(rows.select(*active), active).toPandas()
        for place, search in enumerate(active.values()):
            search.narrow(counted[counted["place"] == place])
        active = {c: s for c, s in active.items() if s.open}
    return {column: search.results() for column, search in zip(wanted, searches.values())}
