"""Vectors, label suggestions, classifiers, splits and training sets, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions import text, values
from pulse.operators import multilabel
from pulse.operators.mutate import union_all
from pulse.operators.ordered import HELPER_ROWS, HOT_ROWS, broadcast_if_small, with_fill, with_row_number, with_running_total
from pulse.operators.ranking import drop_last, keep_large_groups, with_position
from pulse.session import settle

# Columns that can be hashed and compared natively.
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class HashingEncoder:
    """Text to a unit vector of hashed word weights."""

    model: PipelineModel

    @staticmethod
    def fit(df: DataFrame, column: str, size: int = 1024) -> HashingEncoder:
        stages = Pipeline(
            stages=[
                HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size),
                IDF(inputCol="_counts", outputCol="_weights"),
                Normalizer(inputCol="_weights", outputCol="_vector"),
            ]
        )
        return HashingEncoder(stages.fit(_cut(df, column).select("_words")))

    def transform(self, df: DataFrame, column: str, output: str = "vector") -> DataFrame:
        done = self.model.transform(_cut(df, column))
        return done.withColumn(output, F.col("_vector")).drop("_words", "_counts", "_weights", "_vector")


@dataclass(frozen=True)
class FunctionEncoder:
    """Vectors from a user's model: ``load`` runs once per task and gives a function from texts to a matrix."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    batch_rows: int = 64

    def transform(self, df: DataFrame, column: str, output: str = "vector") -> DataFrame:
        load = self.load

        def start() -> Callable[[np.ndarray], np.ndarray]:
            encode = load()
            return lambda texts: np.asarray(encode([str(t) for t in texts]), dtype="float32")

        encoder = predict_batch_udf(start, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_rows)
        return df.withColumn(output, array_to_vector(encoder(F.coalesce(column, F.lit("")))))


def _cut(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_words", F.coalesce(text.words(F.lower(column)), F.array().cast("array<string>")))


def embed(df: DataFrame, column: str, encoder: HashingEncoder | FunctionEncoder, output: str = "vector") -> DataFrame:
    """Add a vector of a text column."""
    return encoder.transform(df, column, output)


def embed_phrase(spark: SparkSession, phrase: str, encoder: HashingEncoder | FunctionEncoder) -> DataFrame:
    """One row with the vector of a phrase: a seed for similarity ranking."""
    return encoder.transform(spark.createDataFrame([(phrase,)], "phrase string"), "phrase")


def as_array(df: DataFrame, column: str = "vector") -> DataFrame:
    """Vector column as an array of doubles."""
    return df.withColumn(column, vector_to_array(column))


@dataclass(frozen=True)
class LabelSuggester:
    """One yes/no model per label; suggests every label with probability above one half."""

    names: list[str]
    weights: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def fit(df: DataFrame, labels: str, names: Sequence[str], vector: str = "vector", rounds: int = 20) -> LabelSuggester:
        """Train all labels at once on rows with a list of labels; ``names`` is the taxonomy to choose from."""
        rows = df.select(labels, vector_to_array(vector).alias("_vector"))
        return LabelSuggester(list(names), *multilabel.fit(rows, labels, list(names), "_vector", rounds, 0.01))

    def transform(self, df: DataFrame, output: str, vector: str = "vector") -> DataFrame:
        if not self.names:
            return df.withColumn(output, F.array().cast("array<string>"))
        weights, offsets = self.weights, self.offsets

        @F.pandas_udf("array<boolean>")
        def likely(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                scores = np.stack(batch.to_numpy()) @ weights.T if len(batch) and weights.size else np.zeros((len(batch), 1))
                yield pd.Series(list(scores + offsets > 0))

        names = F.array(*[F.lit(n) for n in self.names])
        return df.withColumn(output, values.labels_from_mask(names, likely(vector_to_array(vector))))


def suggest_labels(df: DataFrame, suggester: LabelSuggester | None, output: str, vector: str = "vector") -> DataFrame:
    """Add suggested labels; without a model the column is left out."""
    return df if suggester is None else suggester.transform(df, output, vector)


def train_labels(df: DataFrame, vector: str = "vector", label: str = "label", rounds: int = 50) -> PipelineModel:
    """Classifier of ``theme > index`` labels."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_class", stringOrderType="alphabetAsc", handleInvalid="keep"),
            LogisticRegression(
                featuresCol=vector, labelCol="_class", family="multinomial", maxIter=rounds, regParam=0.01
            ),
        ]
    ).fit(df)


def ranked_labels(df: DataFrame, model: PipelineModel, output: str = "suggested_labels", k: int | None = None) -> DataFrame:
    """Labels of each row from most to least likely."""
    names = model.stages[0].labels
    scored = model.stages[-1].transform(df)
    listed = F.array(*[F.lit(n) for n in names])
    chances = F.slice(vector_to_array("probability"), 1, len(names))
    ranked = values.labels_by_score(listed, chances, k)
    return scored.withColumn(output, ranked).drop("rawPrediction", "probability", "prediction")


def stratified_split(
    df: DataFrame,
    strata: str,
    key: str,
    test: float = 0.2,
    validation: float = 0.0,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``split``: test, validation or train, with the same shares in every stratum.

    Rows are ordered by a hash of their key and the seed, so the split depends
    neither on partitions nor on the order of the input. The validation share is
    taken of the rows left after the test split.

    Only strata and keys are shuffled and ordered; they give the last key of each split
    per stratum, and every row compares its own key with these where it lies. A key that
    repeats across the end of a split has its rows numbered, and no others.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    at = F.struct(F.col("_hash").alias("hash"), F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    keys = hashed.groupBy(strata, "_hash", key).agg(F.count("*").alias("_same"))
    counted = with_running_total(keys, [strata], ["_hash", key], "_same", "_until", hot_rows)
    sizes = df.groupBy(strata).agg(F.count("*").alias("_rows")).withColumnRenamed(strata, "_stratum")
    in_test = F.round(F.col("_rows") * F.lit(test))
    in_validation = F.round((F.col("_rows") - in_test) * F.lit(validation))
    counted = counted.join(sizes, F.col(strata).eqNullSafe(F.col("_stratum")))
    counted = counted.select("_stratum", at.alias("_at"), (F.col("_until") - F.col("_same")).alias("_before"), "_until",
                             in_test.alias("_test"), (in_test + in_validation).alias("_end"))
    torn = [(F.col("_before") < F.col(c)) & (F.col(c) < F.col("_until")) for c in ("_test", "_end")]
    ends = counted.groupBy("_stratum").agg(
        F.max(F.when(F.col("_until") <= F.col("_test"), F.col("_at"))).alias("_last_test"),
        F.max(F.when(F.col("_until") <= F.col("_end"), F.col("_at"))).alias("_last"),
        # At most two keys.
        F.collect_list(F.when(torn[0] | torn[1], F.struct("_at", "_before"))).alias("_torn"),
        F.first("_test").alias("_test"),
        F.first("_end").alias("_end"),
    )
    ends = settle(ends)
    joined = hashed.join(broadcast_if_small(ends, HELPER_ROWS), F.col(strata).eqNullSafe(F.col("_stratum")))
    split = F.when(at <= F.col("_last_test"), "test").when(at <= F.col("_last"), "validation").otherwise("train")
    if ends.where(F.size("_torn") > 0).isEmpty():
        done = joined.withColumn("split", split)
    else:
        own = F.filter("_torn", lambda x: x["_at"] == at)
        whole = joined.where(F.size(own) == 0).withColumn("split", split)
        parted = joined.where(F.size(own) > 0).withColumn("_before", own[0]["_before"])
        # Rows of one key are told apart by their plain columns.
        plain = [f.name for f in df.schema if isinstance(f.dataType, _PLAIN)]
        mixed = parted.withColumn("_mix", F.xxhash64(F.lit(seed), *plain))
        numbered = with_row_number(mixed, [strata, "_hash", key], ["_mix"], "_place", hot_rows)
        place = F.col("_before") + F.col("_place")
        by_place = F.when(place <= F.col("_test"), "test").when(place <= F.col("_end"), "validation").otherwise("train")
        done = whole.unionByName(numbered.withColumn("split", by_place).drop("_before", "_mix", "_place"))
    return done.drop("_hash", "_stratum", "_last_test", "_last", "_torn", "_test", "_end")


def class_codes(df: DataFrame, label: str, output: str = "label_class") -> DataFrame:
    """Number the distinct labels from 0 in alphabetical order."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = with_position(names, [label], output).withColumn(output, F.col(output) - 1)
    return df.join(codes, label, "left")


def taxonomy_labels(df: DataFrame, position: str, theme: str = "theme", index: str = "index") -> DataFrame:
    """Sorted distinct ``theme > index`` labels of a taxonomy sheet.

    The last row of the sheet is a note; blank cells repeat the cell above.
    """
    rows = drop_last(df, position).dropna("all", subset=[theme, index])
    filled = with_fill(rows, [], [position], [theme, index])
    pairs = filled.select(theme, index).distinct()
    return pairs.select(text.join_label(F.col(theme), F.col(index)).alias("label")).orderBy("label")


def create_dataset(labelled: DataFrame, base: DataFrame, taxonomy: DataFrame, min_rows: int = 2) -> DataFrame:
    """Training rows whose label is frequent enough and in the taxonomy."""
    columns = ["published", "headline", "label"]
    rows = union_all(base.select(*columns), labelled.select(*columns).where(F.col("label").isNotNull()))
    frequent = keep_large_groups(rows.where(F.col("label").isNotNull()), "label", min_rows)
    return frequent.join(taxonomy.select("label"), "label", "left_semi").select(*columns)


@dataclass(frozen=True)
class FusionModel:
    """Text vector and numeric features in one small network."""

    assembler: VectorAssembler
    network: object

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.network.transform(self.assembler.transform(df))
        return scored.withColumn("pred_y", F.col("prediction").cast("int")).drop(
            "_inputs", "rawPrediction", "probability", "prediction"
        )


def fusion_classifier(
    train: DataFrame,
    numeric: Sequence[str],
    vector: str = "vector",
    label: str = "label",
    hidden: int = 64,
    classes: int = 3,
    rounds: int = 50,
    batch: int = 128,
    seed: int = 42,
) -> FusionModel:
    """Network with one hidden layer over the text vector and the numeric features."""
    assembler = VectorAssembler(inputCols=[vector, *numeric], outputCol="_inputs", handleInvalid="keep")
    rows = assembler.transform(train).select("_inputs", F.col(label).cast("double").alias("_target"))
    first = rows.select("_inputs").first()
    if first is None:
        raise ValueError("no training rows")
    network = MultilayerPerceptronClassifier(
        featuresCol="_inputs",
        labelCol="_target",
        layers=[len(first["_inputs"]), hidden, classes],
        maxIter=rounds,
        blockSize=batch,
        seed=seed,
    )
    return FusionModel(assembler, network.fit(rows))
