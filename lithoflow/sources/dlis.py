"""DLIS files as DataFrames: channel metadata, and frames as tables of their scalar channels."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.sources import rp66

#: Rows of a frame that a task holds at a time.
BATCH = 4096
CHANNELS = "path string, file string, logical_file int, frame string, frame_ord int, ord int, channel string, is_array boolean, long_name string, units string, code int"


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][lL][iI][sS]").load(path).select("path", "content")


def read_dlis_channels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per channel of each frame of each logical file, in order; a task reads whole files (2 GB each at most)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHANNELS.split(", ")]
        for files in frames:
            for at, data in zip(files["path"], files["content"], strict=True):
                rows = [
                    (at, at.rsplit("/", 1)[-1], i, f.name, j, k, c.name, c.is_array, c.long_name, c.units, c.code)
                    for i, logical in enumerate(rp66.logical_files(data))
                    for j, f in enumerate(logical)
                    for k, c in enumerate(f.channels)
                ]
                yield pd.DataFrame(rows, columns=names)

    return _files(spark, path).mapInPandas(scan, CHANNELS)


def _type(code: int) -> T.DataType:
    if code in rp66.INTEGERS:
        return T.LongType()
    return T.StringType() if code in (rp66.IDENT, rp66.ASCII, rp66.DTIME, rp66.UNITS) else T.DoubleType()


def frame_schema(channels: list[tuple[str, int, bool]]) -> T.StructType:
    """SERIAL and a field per channel (name, code, whether cells are arrays); repeated names get a number."""
    fields, seen = [T.StructField("SERIAL", T.LongType())], {"SERIAL": 1}
    for name, code, is_array in channels:
        seen[name] = seen.get(name, 0) + 1
        own = name if seen[name] == 1 else f"{name}_{seen[name]}"
        fields.append(T.StructField(own, T.ArrayType(_type(code)) if is_array else _type(code)))
    return T.StructType(fields)


def read_dlis_frame(spark: SparkSession, path: str, frame: str, logical_file: int = 0) -> DataFrame:
    """A frame's rows: SERIAL, then its channels in order, arrays included; a frame without rows is an empty table.
    A task holds the file's bytes and BATCH rows.

    path is one file. The schema comes from its metadata, so one small job runs first.
    """
    meta = read_dlis_channels(spark, path).where((F.col("frame") == frame) & (F.col("logical_file") == logical_file)).orderBy("ord").collect()
    if not meta:
        raise ValueError(f"{path}: logical file {logical_file} has no frame {frame} with channels")
    schema = frame_schema([(r["channel"], r["code"], r["is_array"]) for r in meta])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for data in files["content"]:
                found = rp66.rows(data, logical_file, frame)
                while part := list(islice(found, BATCH)):
                    yield pd.DataFrame([(n, *cells) for n, cells in part], columns=schema.names)

    return _files(spark, path).mapInPandas(scan, schema)
