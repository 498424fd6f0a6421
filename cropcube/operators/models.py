"""Classifiers on feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows with all features, as ``features`` and ``label``."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df.withColumn("label", F.col(label).cast("double")).where("label IS NOT NULL"))


def estimator(kind: str, **params):
    """rf, gbm (one against the rest, since gradient boosting knows two classes), bayes, mlp or logistic."""
    if kind == "rf":
        return RandomForestClassifier(numTrees=params.get("trees", 200), maxDepth=params.get("depth", 8), seed=params.get("seed", 1))
    if kind == "gbm":
        return OneVsRest(classifier=GBTClassifier(maxIter=params.get("rounds", 20), maxDepth=params.get("depth", 4), stepSize=params.get("rate", 0.1), seed=params.get("seed", 1)))
    if kind == "bayes":
        return NaiveBayes(modelType="gaussian", smoothing=params.get("smoothing", 6.0))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=params["layers"], maxIter=params.get("rounds", 50), seed=params.get("seed", 1))
    return LogisticRegression(maxIter=params.get("rounds", 50))


def predicted(train: DataFrame, test: DataFrame, kind: str, **params) -> DataFrame:
    """``test`` with ``truth`` and ``pred``."""
    out = estimator(kind, **params).fit(train).transform(test)
    return out.select(*[c for c in test.columns if c not in ("features", "label")], F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))


def normalized(train: DataFrame, columns: Sequence[str]):
    """A projection that takes the training mean off each column and divides by the training range (1 if that is 0)."""
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
    span = lambda c: (stats[f"b_{c}"] - stats[f"a_{c}"]) or 1.0
    return lambda df: df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(span(c)) for c in columns})


def principal(train: DataFrame, test: DataFrame, columns: Sequence[str], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Scores on the training table's principal axes (each turned so that its largest loading is positive)."""
    scale = normalized(train, columns)
    made: PipelineModel = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="cc_v", handleInvalid="skip"), PCA(k=k, inputCol="cc_v", outputCol="cc_pc")]).fit(scale(train))
    axes = made.stages[1].pc.toArray()
    sign = [1.0 if axes[abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]

    def scores(df: DataFrame) -> DataFrame:
        out = made.transform(scale(df)).withColumn("cc_a", vector_to_array("cc_pc"))
        return out.withColumns({f"pc{i + 1}": F.col("cc_a")[i] * sign[i] for i in range(k)}).drop("cc_v", "cc_pc", "cc_a")

    return scores(train), scores(test)


def searched(train: DataFrame, grid: dict[str, Sequence], trees: int = 10, parallelism: int = 2, seed: int = 1) -> list[tuple[dict, float]]:
    """Accuracy of each combination on a held-out fifth, best first."""
    rf = RandomForestClassifier(numTrees=trees, seed=seed)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(rf.getParam(name), list(values))
    params = build.build()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    found = TrainValidationSplit(estimator=rf, estimatorParamMaps=params, evaluator=judge, trainRatio=0.8, parallelism=parallelism, seed=seed).fit(train)
    rows = [({p.name: v for p, v in m.items()}, float(s)) for m, s in zip(params, found.validationMetrics, strict=True)]
    return sorted(rows, key=lambda r: (-r[1], sorted(r[0].items())))
