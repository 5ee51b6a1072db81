"""SEG-Y volumes by the public standard (revision 1): fixed-length traces, read in ranges without geometry."""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TEXT, BINARY, TRACE = 3200, 400, 240
#: Sample format code to numpy type; 1 is IBM's hexadecimal floating point.
FORMATS = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 6: ">f8", 8: ">i1"}
#: Bytes of traces that a task reads.
RANGE = 64 << 20
SCHEMA = "TraceIdx bigint, samples array<float>"


def ibm_to_float(x: np.ndarray) -> np.ndarray:
    """IBM single precision: sign, exponent of 16 above 64, 24 bits of fraction."""
    sign = np.where(x >> 31, -1.0, 1.0)
    return sign * (x & 0xFFFFFF).astype(np.float64) / (1 << 24) * 16.0 ** (((x >> 24) & 0x7F).astype(np.float64) - 64)


def header(path: str) -> dict[str, int]:
    """samples per trace, format, bytes before the first trace, bytes of a trace, traces."""
    with open(path, "rb") as f:
        head = f.read(TEXT + BINARY)
    samples, code = struct.unpack_from(">H", head, TEXT + 20)[0], struct.unpack_from(">h", head, TEXT + 24)[0]
    if code not in FORMATS:
        raise ValueError(f"{path}: sample format {code} is not supported")
    start = TEXT + BINARY + TEXT * max(0, struct.unpack_from(">h", head, TEXT + 304)[0])
    size = TRACE + samples * np.dtype(FORMATS[code]).itemsize
    return {"samples": samples, "format": code, "start": start, "size": size, "traces": (os.path.getsize(path) - start) // size}


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, wanted: list[tuple[int, int]] | None):
        self.path, self.wanted = path, wanted

    def partitions(self):
        h = header(self.path)
        step = max(1, RANGE // h["size"])
        return [_Range(a, min(a + step, b)) for low, high in self.wanted or [(0, h["traces"])] for b in [min(high, h["traces"])] for a in range(low, b, step)]

    def read(self, partition):
        import pyarrow as pa

        h = header(self.path)
        n = partition.last - partition.first
        kind = np.dtype([("head", "V240"), ("samples", FORMATS[h["format"]], (h["samples"],))])
        for at in range(partition.first, partition.first + n, 1024):
            count = min(1024, partition.last - at)
            raw = np.fromfile(self.path, kind, count, offset=h["start"] + at * h["size"])["samples"]
            values = ibm_to_float(raw.astype(np.uint32)) if h["format"] == 1 else raw
            flat = pa.array(np.ascontiguousarray(values, dtype=np.float32).ravel())
            offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * h["samples"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(raw), dtype=np.int64)), pa.ListArray.from_arrays(offsets, flat)], names=["TraceIdx", "samples"])


class Segy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        ranges = self.options.get("ranges")
        return _Reader(self.options["path"], [tuple(map(int, r.split("-"))) for r in ranges.split(",")] if ranges else None)


def read_segy(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(TraceIdx, samples): traces by their place in the file, from 0; ranges: only those from first to before last.

    Each task seeks to its own range of about 64 MB; the file must be on a file system that executors mount.
    """
    spark.dataSource.register(Segy)
    reader = spark.read.format("segy")
    if ranges:
        reader = reader.option("ranges", ",".join(f"{a}-{b}" for a, b in ranges))
    return reader.load(path)


def sample_count(path: str) -> int:
    return header(path)["samples"]
