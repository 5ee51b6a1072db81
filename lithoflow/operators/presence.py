"""Which rows have which columns: presence matrices, prevalence, division, first and last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns that a presence matrix may have.
COLUMNS = 20_000


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values in code-point order."""
    return df.select(*columns).distinct().orderBy(*columns)


def column_values(facts: DataFrame, col: str, most: int = COLUMNS) -> list[str]:
    """The distinct non-null values of col, sorted: a matrix's columns. They come to the driver, as a schema must; more than `most` are an error."""
    found = [r[0] for r in distinct_sorted(facts.where(F.col(col).isNotNull()), col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a matrix has at most {most} columns; use the facts in long form")
    return found


def presence_matrix(roster: DataFrame, facts: DataFrame, row: str, col: str, values: list | None = None) -> DataFrame:
    """One row per roster row, one 0/1 integer column per value; rows without a fact are all zero.

    Facts are counted down to one row a roster row before the join; values not in the list are left out. values: the
    matrix's columns, else all of the facts', sorted.
    """
    values = column_values(facts, col) if values is None else values
    some = facts.where(F.col(col).isin(values)) if values else facts.limit(0)
    marks = [F.max(F.when(F.col(col) == v, 1).otherwise(0)).alias(str(v)) for v in values]
    names = roster.select(row).distinct()
    if not values:
        return names
    wide = some.groupBy(row).agg(*marks)
    return names.join(wide, row, "left").select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("int").alias(str(v)) for v in values])


def prevalence(roster: DataFrame, facts: DataFrame, row: str, col: str) -> DataFrame:
    """(col, total_rows, ones): for each value the rows of the roster and those that have it; in long form, without a pivot."""
    names = roster.select(row).distinct()
    total = names.agg(F.count("*").alias("total_rows"))
    ones = facts.select(row, col).distinct().join(names, row, "left_semi").groupBy(col).agg(F.count("*").alias("ones"))
    return ones.where(F.col(col).isNotNull()).join(F.broadcast(total)).select(col, "total_rows", "ones")  # one row


def present_in_all(facts: DataFrame, member: str, group: str, groups: list) -> DataFrame:
    """Members with a fact in each of the groups; a group without facts makes the answer empty."""
    some = facts.where(F.col(group).isin(groups)) if groups else facts.limit(0)
    return some.groupBy(member).agg(F.count_distinct(group).alias("__n")).where(F.col("__n") == len(set(groups))).select(member)


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key no row of other has."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, values: list[str], default: str = "") -> DataFrame:
    """df with values of table's row of its key; `default` where there is no row or its value is null."""
    found = df.join(table.select(key, *values), key, "left")
    return found.withColumns({v: F.coalesce(v, F.lit(default)) for v in values})


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column], values: list[str]) -> DataFrame:
    """values of each key's first row; a null there stays."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.struct(*[c.alias(f"__{i}") for i, c in enumerate(by)], *[F.col(v) for v in values])
    return df.groupBy(*keys).agg(F.min(packed).alias("__first")).select(*keys, *[F.col("__first")[v].alias(v) for v in values])


def last_wins(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """value of each key's last row in which it is not null."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def channel_dictionary(channels: DataFrame, order: list[str | Column]) -> DataFrame:
    """(Channel Name, Long Name, Unit) of scalar channels from their first sighting; nulls there are empty."""
    scalar = channels.where(~F.col("is_array"))
    first = first_wins(scalar, ["channel"], order, ["long_name", "units"])
    named = lookup(first.select("channel"), first, "channel", ["long_name", "units"])
    return named.select(F.col("channel").alias("Channel Name"), F.col("long_name").alias("Long Name"), F.col("units").alias("Unit")).orderBy("Channel Name")


def channel_matrix(channels: DataFrame) -> DataFrame:
    """`Well_Frame Name` by scalar channel, sorted both ways; frames without one are no row."""
    scalar = channels.where(~F.col("is_array")).withColumn("Well_Frame Name", F.concat_ws("_", "well", "frame"))
    return presence_matrix(scalar, scalar, "Well_Frame Name", "channel").orderBy("Well_Frame Name")
