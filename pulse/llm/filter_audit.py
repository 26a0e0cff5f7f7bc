"""Which filter removes which documents, in every order of five filters.

One aggregate over the corpus counts documents per part and set of failed filters. From it the removals
of all 32 coalitions (documents that fail at least one filter of the coalition) are tabulated, once for
all documents, once for good and once for toxic ones. A step of an order is the difference of two
coalitions; a filter's Shapley value is the solution of the least squares problem over all coalitions
with the Shapley kernel as weights and the total as constraint, solved in rationals.

A null text counts as empty, a null part as the empty string. A row without an id is neither a copy nor an
original. Rows that repeat an id with the same text are not copies of each other, as no id is smaller.
A document is good (toxic) if any label row of its id says 1; labels without an id count for nothing.
An empty table gives no rows. Other columns, also of the same names as helpers, are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.quality_rules import WORD, let
from pulse.session import settle

FILTERS = "ABCDE"
N = len(FILTERS)
FULL = 2**N - 1
ORDERS = 120


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: short, repetitive, shouting, with symbols."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    bit = lambda failed, n: F.when(failed, F.lit(1 << n)).otherwise(F.lit(0))
    by_words = let(
        words,
        lambda w: bit(F.size(w) < 200, 0) + bit(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 1),
    )
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return by_words + bit(100 * capitals.cast("long") > 2 * F.length(whole), 2) + bit(whole.rlike(r"[#$%&*|]"), 3)


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents, good and toxic ones per part and ``mask`` of failed filters.

    Copies are found without joining documents: rows are counted per text digest, part and labels with their
    smallest id first, so a text that a third of all documents share is a few rows afterwards.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        text_mask(F.col(text)).alias("mask"),
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kind = ["part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    # Rows with the same id and text first, then the number of those that hold the smallest id.
    each = rows.join(marks, "id", "left").groupBy("id", "digest", *kind).agg(F.count("*").alias("n"))
    same = each.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("without"),
        F.min_by("n", "id").alias("at_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    originals = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    split = same.withColumn("first", first).withColumn("originals", originals)
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + F.lit(16)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    counts = split.select("part", "good", "toxic", F.inline(sides)).groupBy("part", "mask")
    return counts.agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def coalitions(counts: DataFrame) -> DataFrame:
    """Documents, good and toxic ones that each of the 32 coalitions removes, per part."""
    every = F.explode(F.sequence(F.lit(0), F.lit(FULL)))
    rows = counts.withColumn("coalition", every)
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0))).alias(c)
    return rows.groupBy("part", "coalition").agg(removed("docs"), removed("good"), removed("toxic"), F.sum("docs").alias("total"))


def kernel(size: int, n: int = N) -> Fraction:
    return Fraction(n - 1, comb(n, size) * size * (n - size))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination in rationals."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(n: int = N) -> list[list[Fraction]]:
    """Weight of every coalition's value in every filter's Shapley value.

    The normal equations of sum k(S) (v(S) - sum of phi over S)^2 with sum of phi = v(all), for unit values
    of each coalition: one right-hand side per coalition, none of which depends on the documents.
    """
    inner = [s for s in range(1, 2**n - 1)]
    k = {s: kernel(s.bit_count(), n) for s in inner}
    has = lambda s, i: s >> i & 1
    matrix = [[sum((k[s] for s in inner if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[k[s] if s in k and has(s, i) else Fraction(0) for s in range(2**n)] for i in range(n)]
    right.append([Fraction(int(s == 2**n - 1)) for s in range(2**n)])
    return solve(matrix, right)[:n]


def shapley(game: DataFrame, value: str = "docs") -> DataFrame:
    """Per part, the removals of each filter summed over all orders, as an array in filter order."""
    weights = [[ORDERS * w for w in row] for row in shapley_weights()]
    scale = max(w.denominator for row in weights for w in row)
    total = []
    for row in weights:
        table = F.array(*(F.lit(int(w * scale)).cast("decimal(20,0)") for w in row))
        total.append((F.sum(F.get(table, F.col("coalition")) * F.col(value)) / scale).cast("long"))
    return game.groupBy("part").agg(F.array(*total).alias("shapley"))


def steps() -> list[tuple[str, int, int, int]]:
    """Order, step, filter number and the coalition removed before it, for all orders."""
    out = []
    for order in permutations(range(N)):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(FILTERS[x] for x in order), step, i, before))
            before |= 1 << i
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counts of ``failures``."""
    game = settle(coalitions(counts))
    table = game.groupBy("part").agg(
        F.first("total").alias("total"),
        *(F.map_from_entries(F.collect_list(F.struct("coalition", c))).alias(c) for c in ("docs", "good", "toxic")),
    )
    plan = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(i).alias("i"), F.lit(b).alias("before")) for o, s, i, b in steps()))
    rows = table.join(shapley(game), "part").select("*", F.inline(plan))
    own = F.get(F.array(*(F.lit(1 << i) for i in range(N))), F.col("i"))
    after = F.col("before") + own
    gone = lambda c: F.col(c)[after] - F.col(c)[F.col("before")]
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("docs")[after]).alias("kept"),
        gone("docs").alias("removed"),
        (F.col("docs")[own] - gone("docs")).alias("redundant"),
        (F.col("docs")[F.lit(FULL)] - F.col("docs")[F.lit(FULL) - own]).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("i")).alias("shapley"),
    )
