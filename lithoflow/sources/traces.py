"""Trace headers: a CSV table with TraceIdx, X and Y."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_traces(spark: SparkSession, path: str, precision: str = "float") -> DataFrame:
    """(TraceIdx, X, Y) in doubles; precision `float` rounds the coordinates to single precision first."""
    table = spark.read.csv(path, header=True)
    return table.select(F.col("TraceIdx").cast("bigint").alias("TraceIdx"), *[F.col(c).cast(precision).cast("double").alias(c) for c in ("X", "Y")])
