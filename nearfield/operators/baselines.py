"""Model baselines on pyspark.ml: logistic, ridge and forest, fitted on the training side of a split."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(df: DataFrame, vector: str) -> DataFrame:
    """``__f``, the column as a vector; a vector is taken as it is, sparse or not."""
    if isinstance(df.schema[vector].dataType, VectorUDT):
        return df.withColumn("__f", F.col(vector))
    return df.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))


def balanced_logistic(train: DataFrame, test: DataFrame, vector: str, label: str, rounds: int = 200) -> DataFrame | None:
    """``test`` with ``score`` (M1): logistic regression, each class weighted n / (2 n_class).

    None if either side has a single class only.
    """
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    if len(counts) != 2 or test.select(label).distinct().count() < 2:
        return None
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    model = LogisticRegression(featuresCol="__f", labelCol=label, weightCol="__w", maxIter=rounds, regParam=1.0 / max(n, 1)).fit(_features(train, vector).withColumn("__w", weight))
    return model.transform(_features(test, vector)).withColumn("score", vector_to_array("probability")[1]).drop("__f", "rawPrediction", "probability", "prediction")


def logistic_on_tokens(train: DataFrame, test: DataFrame, tokens: str, label: str, features: int = 1024) -> DataFrame | None:
    """``test`` with ``score``: balanced logistic regression on hashed tokens; None if a side has a single class."""
    hashed = HashingTF(inputCol=tokens, outputCol="__h", numFeatures=features, binary=True)
    scored = balanced_logistic(hashed.transform(train), hashed.transform(test), "__h", label)
    return None if scored is None else scored.drop("__h")


def forest_on_tokens(train: DataFrame, test: DataFrame, tokens: str, target: str, features: int = 512, trees: int = 120, seed: int = 13) -> DataFrame:
    """``test`` with ``y_pred`` (M3): a random forest on hashed tokens, present or not."""
    tf = HashingTF(inputCol=tokens, outputCol="__f", numFeatures=features, binary=True)
    model = RandomForestRegressor(featuresCol="__f", labelCol=target, numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=6, seed=seed).fit(tf.transform(train))
    return model.transform(tf.transform(test)).withColumnRenamed("prediction", "y_pred").drop("__f")


def ridge_on_tokens(train: DataFrame, test: DataFrame, tokens: str, target: str, alpha: float = 1.0, buckets: int | None = 4096) -> DataFrame:
    """``test`` with ``y_pred`` (M2): ridge regression on token counts; the penalty is alpha / n on raw features.

    Tokens are hashed into ``buckets``; with None every token of the training side is a feature of its own, up
    to 2^18 by frequency.
    """
    tf = HashingTF(inputCol=tokens, outputCol="__f", numFeatures=buckets) if buckets else CountVectorizer(inputCol=tokens, outputCol="__f", vocabSize=1 << 18).fit(train)
    n = train.count()
    model = LinearRegression(featuresCol="__f", labelCol=target, regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False, solver="l-bfgs").fit(tf.transform(train))
    return model.transform(tf.transform(test)).withColumnRenamed("prediction", "y_pred").drop("__f")


def forest(train: DataFrame, test: DataFrame, vector: str, target: str, trees: int = 120, seed: int = 13) -> DataFrame:
    """``test`` with ``y_pred`` (M3): a random forest with the square root of the features at each split."""
    model = RandomForestRegressor(featuresCol="__f", labelCol=target, numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=8, seed=seed).fit(_features(train, vector))
    return model.transform(_features(test, vector)).withColumnRenamed("prediction", "y_pred").drop("__f")
