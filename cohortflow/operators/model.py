"""Baseline classifier on recording features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from .labels import inline_table


def feature_matrix(features: DataFrame, columns: list[str], label: Column | str) -> DataFrame:
    """Numbers only, gaps as 0, assembled into one vector beside ``y``."""
    filled = features.select(
        "file_id", label.alias("y") if not isinstance(label, str) else F.col(label).alias("y"),
        *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
          for c in columns])
    return VectorAssembler(inputCols=columns, outputCol="raw").transform(filled).select(
        "file_id", "y", "raw")


def standardize(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Z-scores fitted on the training part only (population deviation; constant columns give 0).

    Means and deviations come from one aggregate that is part of the plan: nothing runs
    before the result is used.
    """
    fit = train.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("raw")).alias("m")).select(
        F.struct("m.count", vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("variance"))).scalar()
    # the variance is that of a sample
    shrink = F.when(F.col("_fit.count") > 1, (F.col("_fit.count") - 1) / F.col("_fit.count")).otherwise(1.0)
    scaled = F.zip_with(
        F.zip_with("_raw", "_fit.mean", lambda x, m: x - m), "_fit.variance",
        lambda d, v: F.when(v > 0, d / F.sqrt(v * F.col("_shrink"))).otherwise(0.0))

    def apply(part):
        return part.withColumn("_fit", fit).withColumn("_shrink", shrink).withColumn(
            "_raw", vector_to_array("raw")).withColumn("features", array_to_vector(scaled)).drop(
            "_fit", "_shrink", "_raw")
    return apply(train), apply(test)


def baseline_classifier(train: DataFrame):
    """L2 logistic regression on standardized features, solved until nothing moves.

    The penalty of one observation is half the squared weights over the number of rows.
    """
    n = train.count()
    return LogisticRegression(featuresCol="features", labelCol="y", maxIter=1000, tol=1e-15,
                              regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                              standardization=False).fit(train)


def predict(model, part: DataFrame) -> DataFrame:
    out = model.transform(part)
    return out.select("file_id", F.col("y").cast("int").alias("y"),
                      F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability")[1].alias("score"))


def coefficient_table(spark, model, columns: list[str]) -> DataFrame:
    """One row per feature, ascending coefficient; as many rows as features."""
    rows = [(c, float(v)) for c, v in zip(columns, model.coefficients)]
    return inline_table(spark, rows, "feature string, coefficient double").orderBy(
        "coefficient", "feature")
