"""LAS sections: curve names and well coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoflow.functions import first_number, trim_ws


def section(lines: DataFrame, opens: Column, titles: Column, key: list[str], pos: str = "pos") -> DataFrame:
    """Lines inside the first section that `opens` begins, up to the next of `titles` that opens none. Further opening lines are left out."""
    whole = Window.partitionBy(*key)
    marked = lines.withColumn("__opens", F.coalesce(opens, F.lit(False)))
    marked = marked.withColumn("__start", F.min(F.when(F.col("__opens"), F.col(pos))).over(whole))
    closes = titles & ~F.col("__opens") & (F.col(pos) > F.col("__start"))
    marked = marked.withColumn("__end", F.min(F.when(closes, F.col(pos))).over(whole))
    inside = (F.col(pos) > F.col("__start")) & ((F.col(pos) < F.col("__end")) | F.col("__end").isNull()) & ~F.col("__opens")
    return marked.where(inside).drop("__opens", "__start", "__end")


def _section(lines: DataFrame, title: str, key: list[str]) -> DataFrame:
    """Trimmed lines of the section whose title begins so; any line that begins with ~ is a title."""
    trimmed = lines.withColumn("line", trim_ws("line"))
    return section(trimmed, F.startswith(F.col("line"), F.lit(title)), F.startswith(F.col("line"), F.lit("~")), key)


def curve_names(lines: DataFrame, strict: bool = False, key: list[str] | None = None) -> DataFrame:
    """key, pos and curve of every curve line, repeats included.

    The section opens at a line that begins with `~C`; a name is what stands before a line's first dot. strict leaves out
    comments, which else give names too.
    """
    key = key or ["file"]
    found = _section(lines, "~C", key)
    if strict:
        found = found.where(~F.startswith(F.col("line"), F.lit("#")))
    named = found.where(F.contains(F.col("line"), F.lit("."))).withColumn("curve", trim_ws(F.substring_index("line", ".", 1)))
    return named.where(F.col("curve") != "").select(*key, "pos", "curve")


def well_coordinates(lines: DataFrame, signed: bool = False, key: list[str] | None = None) -> DataFrame:
    """key, x and y of each file: the last number in a line with XCRD, else YCRD, of its parameter section; null without one."""
    key = key or ["file"]
    found = _section(lines, "~Parameter", key)
    has_x = F.contains(F.col("line"), F.lit("XCRD"))
    has_y = ~has_x & F.contains(F.col("line"), F.lit("YCRD"))
    value = first_number("line", signed)
    numbered = found.withColumn("__v", value).where(F.col("__v").isNotNull())
    at = numbered.groupBy(*key).agg(F.max_by("__v", F.when(has_x, F.col("pos"))).alias("x"), F.max_by("__v", F.when(has_y, F.col("pos"))).alias("y"))
    return lines.select(*key).distinct().join(at, key, "left")


def coordinate_diagnostics(coordinates: DataFrame, key: str = "file") -> DataFrame:
    """(file, stage, message) of files without a coordinate."""
    lost = coordinates.where(F.col("x").isNull() | F.col("y").isNull())
    return lost.select(F.col(key).alias("file"), F.lit("coordinates").alias("stage"), F.lit("no XCRD or YCRD value").alias("message"))
