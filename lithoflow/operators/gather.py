"""Trace lists joined to trace volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_gather(trace_list: DataFrame, volume: DataFrame, id_col: str = "TraceIdx", samples: str = "samples") -> DataFrame:
    """trace_list with its traces' samples; its order (column ord, if there) and repeats stay. Traces out of range have none."""
    return trace_list.join(volume.select(id_col, samples), id_col, "left")


def check_gathered(cube: DataFrame, samples: str = "samples", id_col: str = "TraceIdx") -> DataFrame:
    """The cube, or an error if a trace of the list is not in the volume."""
    lost = cube.where(F.col(samples).isNull()).select(id_col).head(1)
    if lost:
        raise IndexError(f"trace {lost[0][0]} is not in the volume")
    return cube


def id_ranges(trace_list: DataFrame, id_col: str = "TraceIdx", gap: int = 1024, most: int = 10_000) -> list[tuple[int, int]] | None:
    """Ranges (first, before last) of the ids listed, for a reader that seeks; None if there are more than most.

    Ids meet in blocks of `gap` first, so that at most `most` blocks come to the driver.
    """
    blocks = trace_list.where(F.col(id_col).isNotNull()).select(F.floor(F.col(id_col) / gap).alias("b")).distinct().orderBy("b").limit(most + 1).collect()
    if len(blocks) > most:
        return None
    out: list[list[int]] = []
    for (b,) in blocks:
        if out and out[-1][1] == b * gap:
            out[-1][1] = (b + 1) * gap
        else:
            out.append([b * gap, (b + 1) * gap])
    return [(a, b) for a, b in out]
