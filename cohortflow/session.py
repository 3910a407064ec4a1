"""Session options the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

OPTIONS = {
    # HotSpot does not compile methods above 8000 bytes: let Spark split the
    # expressions of such a stage instead of running one interpreted method
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows of samples are large: bound the batches that go to Python by size
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set run-time options; adaptive execution and skew joins stay at Spark's defaults."""
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    return spark
