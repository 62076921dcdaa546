"""Boosted trees with Spark ML: train, score, importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters. Spark's trees stop at depth 30; the row share is sampled per tree."""

    trees: int = 500
    depth: int = 12
    learning_rate: float = 0.05
    row_share: float = 0.75
    feature_share: float = 0.5
    bins: int = 64
    seed: int = 42


def train(df: DataFrame, features: Sequence[str], label: str, params: TreeParams = TreeParams()) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(
        featuresCol="_features", labelCol=label, predictionCol="_pred", maxIter=params.trees, maxDepth=params.depth,
        stepSize=params.learning_rate, subsamplingRate=params.row_share, featureSubsetStrategy=str(params.feature_share),
        maxBins=params.bins, seed=params.seed, checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, trees]).fit(df)


def score(model: PipelineModel, df: DataFrame, pred: str = "pred") -> DataFrame:
    """Add the hard prediction and the class-1 probability."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    keep = [F.col(c) for c in df.columns if c not in (pred, "probability")]
    return scored.select(*keep, F.col("_pred").cast("int").alias(pred), vector_to_array("probability")[1].alias("probability"))


def train_and_score(train_df: DataFrame, eval_df: DataFrame, features: Sequence[str], label: str, params: TreeParams = TreeParams(), pred: str = "pred") -> tuple[PipelineModel, DataFrame]:
    model = train(train_df, features, label, params)
    return model, score(model, eval_df, pred)


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance); one row per model input."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n most important features."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)
