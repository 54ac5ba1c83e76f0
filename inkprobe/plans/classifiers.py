"""Single classifiers by name. Each is fitted on ``features, label`` and adds ``score``."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkprobe.fits.grouped import FITTERS, fit_runs, load_models, row_key, save_models
from inkprobe.fits.table import shared
from inkprobe.operators.classes import balanced_weights
from inkprobe.session import stage

# Names of the reference's experiment files, and what stands for them here.
ALIASES = {"xgboost": "gbt", "xgboost_calibrated": "gbt_calibrated", "deep_mlp": "mlp"}


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric columns, or one array column, as one vector column."""
    kinds = dict(df.dtypes)
    if len(columns) == 1 and kinds[columns[0]].startswith("array"):
        return df.withColumn(name, array_to_vector(F.col(columns[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def population_scaler(rows: int, width: int, source: str = "features", target: str = "scaled") -> list:
    """Stages for ``(x - mean) / std`` with the population std.

    The built-in scaler divides by the sample std; both differ by one constant factor.
    A feature without variance becomes 0.
    """
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return [
        StandardScaler(inputCol=source, outputCol="_centred", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="_centred", outputCol=target, scalingVec=Vectors.dense([factor] * width)),
    ]


def _probability(df: DataFrame, source: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(source)[1])


def without_summary(model: Transformer) -> Transformer:
    """The model without the summary of its training. The summary holds the session, which travels with the model to the
    tasks and can't be sent once the session has observed anything (``DataFrame.observe``)."""
    for part in getattr(model, "stages", [model]):
        if getattr(part, "hasSummary", False):
            part._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


class Fitted:
    """A fitted classifier: ``predict`` adds the probability of class 1 as ``score``."""

    def __init__(self, model: Transformer):
        self.model = model

    def predict(self, df: DataFrame) -> DataFrame:
        return _probability(self.model.transform(df)).drop("rawPrediction", "probability", "prediction")


class FittedRun:
    """A classifier of ``inkprobe.fits``; ``facts`` are what was said about it when it was saved."""

    def __init__(self, model: Any, features: str = "features", facts: Mapping[str, Any] | None = None):
        self.model, self.features, self.facts = model, features, dict(facts or {})

    def predict(self, df: DataFrame) -> DataFrame:
        data = shared(df, {0: self.model})

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(data.value[0].scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        kind = dict(df.dtypes)[self.features]
        return df.withColumn("score", score(F.col(self.features).cast("array<double>") if kind.startswith("array") else vector_to_array(self.features)))

    def save(self, spark: SparkSession, path: str) -> None:
        save_models(spark, {0: self.model}, path, {"features": self.features, **self.facts})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedRun:
        models, facts = load_models(spark, path)
        return cls(models[0], facts.pop("features", "features"), facts)


def _logreg(train: DataFrame, features: str, seed: int, balanced: bool = True, max_iter: int = 2000) -> Fitted:
    """Of any width, without second derivatives. L2 with C = 1 and classes weighted to balance: the weights sum to n, so C = 1 is 1/n."""
    rows = train.count()
    if balanced:
        train = balanced_weights(train, "label")
    estimator = LogisticRegression(
        featuresCol=features, labelCol="label", regParam=1.0 / rows, elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=1e-6, **({"weightCol": "weight"} if balanced else {}),
    )
    model = estimator.fit(train)
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"logistic regression stopped after {max_iter} iterations without converging", stacklevel=2)
    return Fitted(without_summary(model))


def list_classifiers() -> list[str]:
    return [*FITTERS, *ALIASES]


def fit_classifier(name: str, train: DataFrame, features: str = "features", seed: int = 42, **options) -> Fitted | FittedRun:
    """Fit one classifier on ``features, label`` (``text_id`` too, for the draws of all but the regression).

    Many fits are better given to ``fit_runs``, which shares their jobs.
    """
    known = ALIASES.get(name, name)
    if known not in FITTERS:
        raise KeyError(f"classifier {name!r} is not known; known: {list_classifiers()}")
    if known == "logreg":
        return _logreg(train, features, seed, **options)
    rows = train.select(row_key().alias("key"), F.col("label").cast("int").alias("label"), F.array(F.lit(0)).alias("runs"), vector_to_array(features).alias("x"))
    return FittedRun(fit_runs(known, stage(rows, "train"), seed, **options)[0], features)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted chain of stages: columns, scaler and coefficients."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_chain(train: DataFrame, columns: Sequence[str], seed: int = 42, balanced: bool = True) -> PipelineModel:
    """Assembler, population scaler and logistic regression as one chain that can be saved."""
    rows = train.count()
    weighted = balanced_weights(train, "label") if balanced else train.withColumn("weight", F.lit(1.0))
    chain = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="features"),
            *population_scaler(rows, len(columns)),
            LogisticRegression(
                featuresCol="scaled", labelCol="label", weightCol="weight", regParam=1.0 / rows, elasticNetParam=0.0,
                standardization=False, maxIter=2000, tol=1e-6,
            ),
        ]
    ).fit(weighted)
    return without_summary(chain)
