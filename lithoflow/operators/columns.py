"""Choice and shape of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar_columns(df: DataFrame) -> DataFrame:
    """df without array columns, decided by its schema."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)])


def to_wide(df: DataFrame, samples: str, n: int, keep: list[str], prefix: str = "S") -> DataFrame:
    """keep's columns and the first n elements of an array as columns S0, S1 and so on; missing elements are null."""
    return df.select(*keep, *[F.get(samples, i).alias(f"{prefix}{i}") for i in range(n)])


def quantised(x: Column | str) -> Column:
    """A double rounded to single precision."""
    return (F.col(x) if isinstance(x, str) else x).cast("float").cast("double")


def composite_key(*parts: str) -> Column:
    return F.concat_ws("_", *parts)
