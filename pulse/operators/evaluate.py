"""Classification metrics as plain aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.labelling import vote_predictions

METRICS = ("accuracy", "precision", "recall", "f1")


def confusion(df: DataFrame, classes: tuple[int, ...] = (0, 1, 2), truth: str = "label", guess: str = "pred_y") -> DataFrame:
    """Rows per true and predicted class, zero cells included."""
    counts = df.groupBy(truth, guess).agg(F.count("*").alias("count"))
    listed = F.array(*[F.lit(c) for c in classes])
    grid = df.sparkSession.range(1).select(F.explode(listed).alias(truth)).select(truth, F.explode(listed).alias(guess))
    return grid.join(counts, [truth, guess], "left").select(truth, guess, F.coalesce("count", F.lit(0)).alias("count"))


def class_counts(df: DataFrame, truth: str = "label", guess: str = "pred_y") -> DataFrame:
    """Hits, predictions and true rows of each class seen in truth or prediction.

    Rows are counted per (truth, prediction) pair first; what follows works on at
    most classes x classes rows.
    """
    pairs = df.groupBy(truth, guess).agg(F.count("*").alias("rows"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col(truth).alias("class"),
                    F.when(F.col(truth) == F.col(guess), F.col("rows")).otherwise(0).alias("hits"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.col("rows").alias("actual"),
                ),
                F.struct(
                    F.col(guess).alias("class"),
                    F.lit(0).cast("long").alias("hits"),
                    F.col("rows").alias("predicted"),
                    F.lit(0).cast("long").alias("actual"),
                ),
            )
        ).alias("side")
    ).select("side.*")
    return sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "actual")])


def class_metrics(df: DataFrame, truth: str = "label", guess: str = "pred_y") -> DataFrame:
    """Precision, recall, F1 and support per class; undefined values are 0."""

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    hits, predicted, actual = F.col("hits"), F.col("predicted"), F.col("actual")
    return class_counts(df, truth, guess).select(
        "class",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, actual).alias("recall"),
        ratio(2 * hits, predicted + actual).alias("f1"),
        actual.alias("support"),
        "hits",
    )


def evaluate(df: DataFrame, truth: str = "label", guess: str = "pred_y", digits: int = 3) -> DataFrame:
    """Accuracy and macro precision, recall and F1: one row."""
    return class_metrics(df, truth, guess).agg(
        F.round(F.sum("hits") / F.sum("support"), digits).alias("accuracy"),
        *[F.round(F.avg(m), digits).alias(m) for m in METRICS[1:]],
    )


def evaluate_levels(df: DataFrame, weighted: bool = False) -> DataFrame:
    """Macro metrics per article, and per index after its articles have voted."""
    levels = {"article": evaluate(df), "index": evaluate(vote_predictions(df, weighted))}
    return reduce(
        DataFrame.unionByName, [frame.select(F.lit(name).alias("level"), *METRICS) for name, frame in levels.items()]
    )


def class_report(df: DataFrame, truth: str = "label", guess: str = "pred_y") -> DataFrame:
    """Per-class metrics followed by accuracy, macro and weighted averages."""
    classes = class_metrics(df, truth, guess)
    names = ("precision", "recall", "f1")
    rows = classes.select(F.col("class").cast("string").alias("name"), *names, "support")
    total = F.sum("support").alias("support")
    accuracy = F.sum("hits") / F.sum("support")
    averages = [
        classes.agg(*[accuracy.alias(m) for m in names], total).select(F.lit("accuracy").alias("name"), *names, "support"),
        classes.agg(*[F.avg(m).alias(m) for m in names], total).select(F.lit("macro avg").alias("name"), *names, "support"),
        classes.agg(
            *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names], total
        ).select(F.lit("weighted avg").alias("name"), *names, "support"),
    ]
    return reduce(DataFrame.unionByName, averages, rows)


def top_k_accuracy(df: DataFrame, top_k: int = 20, label: str = "label", ranked: str = "suggested_labels") -> DataFrame:
    """Share of rows whose label is among the first k suggestions, for k = 1 up to ``top_k`` - 1."""
    place = F.array_position(ranked, F.col(label))
    by_place = df.groupBy(place.alias("place")).agg(F.count("*").alias("rows"))
    ks = by_place.select(F.explode(F.sequence(F.lit(1), F.lit(top_k - 1))).alias("k"), "place", "rows")
    hit = F.when(F.col("place").between(1, F.col("k")), F.col("rows")).otherwise(0)
    return ks.groupBy("k").agg((F.sum(hit) / F.sum("rows")).alias("accuracy")).orderBy("k")


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """One row per model and one column per metric, from one-row metric frames."""
    named = [frame.select(F.lit(model).alias("model"), *METRICS) for model, frame in results.items()]
    return reduce(DataFrame.unionByName, named).orderBy("model")


def compare_models_wide(results: dict[str, DataFrame]) -> DataFrame:
    """One row per metric and one column per model."""
    long = reduce(
        DataFrame.unionByName,
        [
            frame.unpivot([], list(METRICS), "metric", "value").select(F.lit(model).alias("model"), "metric", "value")
            for model, frame in results.items()
        ],
    )
    return long.groupBy("metric").pivot("model", sorted(results)).agg(F.max("value"))
