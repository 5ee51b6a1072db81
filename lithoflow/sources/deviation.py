"""Deviation surveys: whitespace tables under a second-line header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions import fields, parse_double, trim_ws


def header_names(lines: DataFrame, key: list[str]) -> DataFrame:
    """key and names: the fields of line 1, without leading `#` signs."""
    return lines.where("pos = 1").select(*key, fields(F.regexp_replace("line", "^#+", "")).alias("names"))


def table_rows(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, pos and cells of the lines from 2 on that are not blank."""
    return lines.where(F.col("pos") > 1).where(trim_ws("line") != "").select(*key, "pos", fields("line").alias("cells"))


def table_widths(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, names and widest of each table with a header and a row: the table is usable if the widest row has as many fields as there are names."""
    widest = table_rows(lines, key).groupBy(*key).agg(F.max(F.size("cells")).alias("widest"))
    return header_names(lines, key).join(widest, key)


def deviation_points(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, pos, x and y of each usable row.

    Line 0 is ignored; line 1 names the columns, without leading `#` signs. Blank lines are left out. The widest row must
    have as many fields as the header has names, else the file has no point; shorter rows lack their last columns. Rows
    whose X or Y is no finite number are left out one by one.
    """
    key = key or ["file"]
    good = table_widths(lines, key).where(F.size("names") == F.col("widest"))

    def cell(name: str):
        return parse_double(F.get("cells", (F.array_position("names", name) - 1).cast("int")))

    there = F.array_contains("names", "X") & F.array_contains("names", "Y")
    points = table_rows(lines, key).join(good, key).where(there).select(*key, "pos", cell("X").alias("x"), cell("Y").alias("y"))
    return points.where("x is not null and y is not null")


def deviation_diagnostics(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, stage, message) of files that give no point."""
    key = key or ["file"]
    lost = lines.select(*key).distinct().join(deviation_points(lines, key).select(*key).distinct(), key, "left_anti")
    return lost.select(*key, F.lit("deviation").alias("stage"), F.lit("no usable row").alias("message"))
