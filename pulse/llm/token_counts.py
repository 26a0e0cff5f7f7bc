"""Exact histogram of encoded lengths with suffix sums for every context limit.

Null and empty texts have 0 tokens, repeated rows count each, very long texts are encoded whole; only the text is
read. An empty table gives an empty histogram, and 0 or null answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.byte_bpe import codec, default_path
from pulse.session import settle

# Lengths are cut into blocks of this many, so that no window holds more rows.
BLOCK = 1_024


def encoded_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row ``n_tokens`` per document; null and empty texts have 0 tokens."""
    name = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(name).encode
        for batch in batches:
            sizes = [len(encode(t)) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text)).mapInArrow(count, "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length, with what a context limit of that length answers.

    ``docs_longer`` and ``tokens_longer`` are suffix sums over greater lengths,
    ``docs_upto`` counts documents that fit and ``truncated_total`` is the tokens left
    when every document is cut to this length. An empty table gives no rows. Suffix sums
    go over blocks of lengths, then inside a block; each window is bounded by ``BLOCK``
    rows for lengths below ``BLOCK`` cubed.
    """
    # One row per length is kept, so that the texts are encoded once.
    counts = settle(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    counts = counts.withColumns(
        {
            "tokens": F.col("n_tokens") * F.col("n_docs"),
            "_a": F.expr(f"n_tokens div {BLOCK}"),
            "_b": F.expr(f"n_tokens div {BLOCK * BLOCK}"),
        }
    )

    def later(df: DataFrame, keys: list[str], order: str, docs: str, tokens: str, to: str) -> DataFrame:
        after = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {
                f"{to}_docs": F.coalesce(F.sum(docs).over(after), F.lit(0)),
                f"{to}_tokens": F.coalesce(F.sum(tokens).over(after), F.lit(0)),
            }
        )

    blocks = counts.groupBy("_a", "_b").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    tops = blocks.groupBy("_b").agg(F.sum("_d").alias("_d"), F.sum("_t").alias("_t"))
    tops = later(tops, [], "_b", "_d", "_t", "_top").drop("_d", "_t")
    blocks = later(blocks, ["_b"], "_a", "_d", "_t", "_mid").drop("_d", "_t", "_b")
    rows = later(counts, ["_a"], "n_tokens", "n_docs", "tokens", "_in").join(blocks, "_a").join(tops, "_b")
    longer = F.col("_in_docs") + F.col("_mid_docs") + F.col("_top_docs")
    more = F.col("_in_tokens") + F.col("_mid_tokens") + F.col("_top_tokens")
    return rows.select(
        "n_tokens",
        "n_docs",
        "tokens",
        longer.alias("docs_longer"),
        more.alias("tokens_longer"),
    )


def with_totals(histogram: DataFrame) -> DataFrame:
    """Add fitting documents, quantile rank and truncated totals."""
    totals = histogram.agg(F.sum("n_docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    docs, tokens = totals.first()
    docs, tokens = docs or 0, tokens or 0
    fits = F.lit(docs) - F.col("docs_longer")
    return histogram.withColumns(
        {
            "docs_upto": fits,
            "quantile": fits / F.lit(docs or 1),
            "truncated_total": F.lit(tokens) - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer"),
        }
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit, whether a stored length or not: documents that fit, and tokens left when all are cut to it.

    No limits or no documents give no rows.
    """
    n = F.col("n_tokens")
    asked = F.array(*(F.lit(x) for x in sorted(set(limits)))).cast("array<long>")
    each = histogram.withColumn("limit", F.explode(asked))
    fits, more = n <= F.col("limit"), F.lit(0).cast("long")
    return each.groupBy("limit").agg(
        F.sum(F.when(fits, F.col("n_docs")).otherwise(more)).alias("docs_upto"),
        F.sum(F.col("n_docs") * F.least(n, F.col("limit"))).alias("truncated_total"),
        F.sum(F.when(fits, more).otherwise(F.col("n_docs"))).alias("docs_longer"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed, by the suffix sums."""
    total = F.col("n_docs") + F.col("docs_longer")
    docs = histogram.agg(F.max(total).alias("docs")).first()["docs"]
    if not docs or not shares:
        return histogram.select(F.lit(None).cast("double").alias("share"), F.col("n_tokens")).limit(0)
    each = histogram.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in sorted(set(shares))))))
    reached = F.lit(docs) - F.col("docs_longer") >= F.ceil(F.col("share") * docs)
    return each.where(reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
