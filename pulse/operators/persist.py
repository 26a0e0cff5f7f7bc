"""Saving fitted models below a path and loading them in another session.

Spark ML parts use Spark's own writers and readers; other state is one row of JSON or, for weights,
one row per label.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import SparkSession

from pulse.operators import models, scaling

Model = (
    models.HashingEncoder | models.LabelSuggester | models.FusionModel | PipelineModel
    | scaling.ScalerModel | scaling.MinMaxModel | scaling.PowerModel | scaling.QuantileModel
)


def save(model: Model, path: str) -> str:
    """Write a fitted model to a new or existing path."""
    spark, state = SparkSession.active(), {}
    match model:
        case models.HashingEncoder():
            model.model.write().overwrite().save(f"{path}/model")
        case PipelineModel():
            model.write().overwrite().save(f"{path}/model")
        case models.FusionModel():
            model.assembler.write().overwrite().save(f"{path}/assembler")
            model.network.write().overwrite().save(f"{path}/network")
        case models.LabelSuggester():
            rows = [(i, name, w.tolist(), float(b)) for i, (name, w, b) in enumerate(zip(model.names, model.weights, model.offsets))]
            frame = spark.createDataFrame(rows, "number int, name string, weights array<double>, offset double")
            frame.write.mode("overwrite").parquet(f"{path}/labels")
        case _:
            state = asdict(model)
    about = [(type(model).__name__, json.dumps(state))]
    spark.createDataFrame(about, "kind string, state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def load(spark: SparkSession, path: str) -> Model:
    """The model saved at a path."""
    about = spark.read.parquet(f"{path}/about").first()
    state = json.loads(about["state"])
    match about["kind"]:
        case "HashingEncoder":
            return models.HashingEncoder(PipelineModel.load(f"{path}/model"))
        case "PipelineModel":
            return PipelineModel.load(f"{path}/model")
        case "FusionModel":
            network = MultilayerPerceptronClassificationModel.load(f"{path}/network")
            return models.FusionModel(VectorAssembler.load(f"{path}/assembler"), network)
        case "LabelSuggester":
            rows = spark.read.parquet(f"{path}/labels").orderBy("number").collect()
            weights = np.array([r["weights"] for r in rows]) if rows else np.zeros((0, 0))
            return models.LabelSuggester([r["name"] for r in rows], weights, np.array([r["offset"] for r in rows]))
        case "ScalerModel":
            return scaling.ScalerModel(**state)
        case "MinMaxModel":
            return scaling.MinMaxModel({c: scaling.ScalerModel(**m) for c, m in state["bounds"].items()})
        case "PowerModel":
            return scaling.PowerModel(**{**state, "scaler": scaling.ScalerModel(**state["scaler"])})
        case "QuantileModel":
            return scaling.QuantileModel(**state)
        case kind:
            raise ValueError(f"unknown model: {kind}")
