"""From folders of DLIS files to frame tables, the channel dictionary and the channel matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.operators.presence import channel_dictionary, channel_matrix
from lithoflow.operators.sinks import write_frame, write_small_csv
from lithoflow.sources.dlis import CHANNELS, read_dlis_channels, read_dlis_frame

#: Order of sighting: wells as given, then files by name, logical files, frames and channels as they come.
SIGHTING = ["well_ord", "file", "logical_file", "frame_ord", "ord"]


def well_channels(spark: SparkSession, wells: dict[str, str]) -> DataFrame:
    """Channel metadata of each well's folder, with well and its place in the given order."""
    parts = [read_dlis_channels(spark, folder).withColumn("well", F.lit(w)).withColumn("well_ord", F.lit(i)) for i, (w, folder) in enumerate(wells.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{CHANNELS}, well string, well_ord int")


def export_frames(spark: SparkSession, wells: dict[str, str], out: str) -> list[str]:
    """Each frame's scalar channels as CSV, in a folder of its well, file, logical file and frame; one job a frame."""
    found = well_channels(spark, wells).select("well", "path", "file", "logical_file", "frame").distinct().orderBy("well", "path", "logical_file", "frame").collect()
    return [write_frame(read_dlis_frame(spark, r["path"], r["frame"], r["logical_file"]), out, r["well"], r["file"], r["logical_file"], r["frame"]) for r in found]


def export_channels(spark: SparkSession, wells: dict[str, str], dictionary: str, matrix: str) -> tuple[str, str]:
    """The channel dictionary and the matrix of well frames and channels, as small CSV files with a UTF-8 mark."""
    channels = well_channels(spark, wells)
    return write_small_csv(channel_dictionary(channels, SIGHTING), dictionary, bom=True), write_small_csv(channel_matrix(channels), matrix, bom=True)
