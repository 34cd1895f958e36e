"""A window classifier with class weights."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """total / (classes * rows of the class), joined to each row."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    every = Window.partitionBy()
    n = n.withColumn("weight", F.sum("__n").over(every) / (F.count("*").over(every) * F.col("__n"))).drop("__n")
    return df.join(F.broadcast(n), label)  # as many rows as classes


def fit_windows(df: DataFrame, features: str = "features", label: str = "label", iterations: int = 50) -> PipelineModel:
    """Multinomial logistic regression on pooled window vectors (arrays), rows weighted by class."""
    rows = class_weights(df, label).withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    scale = StandardScaler(inputCol="__v", outputCol="__s", withMean=True)
    return Pipeline(stages=[scale, LogisticRegression(featuresCol="__s", labelCol=label, weightCol="weight", maxIter=iterations)]).fit(rows)


def predict_windows(model: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>"))))
    return out.withColumn("probabilities", vector_to_array("probability")).select(*df.columns, "prediction", "probabilities")
