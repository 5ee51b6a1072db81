"""Exact k-nearest-neighbour join in the plane, ties by the smaller trace id."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.durable import durable

#: Traces that are sent to every task at most: 24 bytes each, 48 MB.
BROADCAST = 2_000_000
#: Traces that a grid cell should hold on average, for each neighbour wanted.
PER_CELL = 2.0
#: Points that are sent to every task at most, where they scan all traces, and growth of cells from round to round.
FEW, GROW = 4096, 4
#: Points whose distances to all traces one step of the broadcast strategy takes: the product stays under this.
DISTANCES = 4_000_000


def _ranked(pairs: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("d2", "TraceIdx")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _d2():
    return (F.col("X") - F.col("x0")) * (F.col("X") - F.col("x0")) + (F.col("Y") - F.col("y0")) * (F.col("Y") - F.col("y0"))


def _exact(points: DataFrame, traces: DataFrame, key: str, k: int) -> DataFrame:
    return _ranked(points.crossJoin(traces).withColumn("d2", _d2()), key, k).select(key, "rank", "TraceIdx", "d2")


def _sent(points: DataFrame, traces: DataFrame, key: str, k: int) -> DataFrame:
    local = traces.toPandas().sort_values("TraceIdx", kind="stable")
    held = points.sparkSession.sparkContext.broadcast((local["TraceIdx"].to_numpy(np.int64), local["X"].to_numpy(float), local["Y"].to_numpy(float)))
    schema = T.StructType([points.schema[key], T.StructField("rank", T.IntegerType()), T.StructField("TraceIdx", T.LongType()), T.StructField("d2", T.DoubleType())])

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, y = held.value
        step = max(1, DISTANCES // max(1, len(ids)))
        for frame in frames:
            for a in range(0, len(frame), step):
                part = frame.iloc[a : a + step]
                d2 = (x[None, :] - part["x0"].to_numpy()[:, None]) ** 2 + (y[None, :] - part["y0"].to_numpy()[:, None]) ** 2
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
                for name, row, far in zip(part[key], d2, kth, strict=True):
                    near = np.nonzero(row <= far)[0]  # ids ascend, so a stable sort keeps ties in order
                    near = near[np.argsort(row[near], kind="stable")][:k]
                    yield pd.DataFrame({key: [name] * k, "rank": np.arange(1, k + 1, dtype=np.int32), "TraceIdx": ids[near], "d2": row[near]})

    return points.select(key, "x0", "y0").mapInPandas(nearest, schema)


def _scan(points: DataFrame, traces: DataFrame, key: str, k: int) -> DataFrame:
    """The few points, of checked number, go to all tasks; each finds its own nearest, and the nearest of those are taken."""
    local = points.toPandas()
    held = points.sparkSession.sparkContext.broadcast((local[key].tolist(), local["x0"].to_numpy(float), local["y0"].to_numpy(float)))
    schema = T.StructType([points.schema[key], T.StructField("TraceIdx", T.LongType()), T.StructField("d2", T.DoubleType())])

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, x0, y0 = held.value
        ids, d2 = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        step = max(k, DISTANCES // max(1, len(names)))
        for frame in frames:
            for a in range(0, len(frame), step):
                part = frame.iloc[a : a + step]
                new = (part["X"].to_numpy()[None, :] - x0[:, None]) ** 2 + (part["Y"].to_numpy()[None, :] - y0[:, None]) ** 2
                d2 = np.hstack([d2, new])
                ids = np.hstack([ids, np.broadcast_to(part["TraceIdx"].to_numpy(np.int64), new.shape)])
                order = np.lexsort((ids, d2), axis=-1)[:, :k]
                ids, d2 = np.take_along_axis(ids, order, 1), np.take_along_axis(d2, order, 1)
        for name, i, d in zip(names, ids, d2, strict=True):
            yield pd.DataFrame({key: [name] * len(i), "TraceIdx": i, "d2": d})

    return _ranked(traces.mapInPandas(nearest, schema), key, k).select(key, "rank", "TraceIdx", "d2")


def _grid(points: DataFrame, traces: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """Cells of a size that holds a few traces; a point looks at the 3 x 3 cells around its own.

    What it finds there is certain if its k-th distance is less than the cell size, as all else is further away. The
    others look again with cells of GROW times the size, until FEW are left, which scan all traces. The first size comes
    from the box of the middle 98 % of traces in either coordinate, so that a few far ones (zeros in headers) don't widen cells.
    """
    middle = lambda c, at: F.percentile_approx(c, at, 1000)
    box = traces.agg(middle("X", 0.01).alias("a"), middle("X", 0.99).alias("b"), middle("Y", 0.01).alias("c"), middle("Y", 0.99).alias("d")).first()
    width, height = max(box["b"] - box["a"], 1e-9), max(box["d"] - box["c"], 1e-9)
    size = max(math.sqrt(width * height * PER_CELL * k / n), max(width, height) / 2**30)
    left, out = durable(points.select(key, "x0", "y0")), None
    while left.limit(FEW + 1).count() > FEW:
        cell = lambda c, at=size: F.floor(F.col(c) / at)
        around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        near = left.withColumn("__i", F.explode(F.transform(around, lambda d: cell("x0") + d))).withColumn("__j", F.explode(F.transform(around, lambda d: cell("y0") + d)))
        found = near.join(traces.withColumn("__i", cell("X")).withColumn("__j", cell("Y")), ["__i", "__j"]).withColumn("d2", _d2())
        best = durable(_ranked(found, key, k).select(key, "rank", "TraceIdx", "d2"))
        sure = best.groupBy(key).agg(F.max("rank").alias("n"), F.max("d2").alias("far")).where((F.col("n") == k) & (F.col("far") < size * size)).select(key)
        done = best.join(sure, key, "left_semi")
        out = done if out is None else out.unionByName(done)
        left = durable(left.join(sure, key, "left_anti"))
        size *= GROW
    rest = _scan(left, traces, key, k)
    return rest if out is None else out.unionByName(rest)


def knn_join(points: DataFrame, traces: DataFrame, k: int = 9, key: str = "pt", strategy: str = "auto", precision: str = "float") -> DataFrame:
    """(key, rank, TraceIdx, d2): the k traces nearest to each point (key, x0, y0), by squared distance and then id.

    precision `float` rounds the traces' coordinates to single precision; points stay doubles. Points or traces with a
    null or non-finite coordinate take no part. Points are told apart by key. strategy: `broadcast` sends the traces to all tasks, `grid` joins
    by cells, `exact` compares all with all (for tests); `auto` counts the traces and sends up to BROADCAST of them.
    More neighbours than traces are an error.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    traces = traces.select(F.col("TraceIdx").cast("bigint").alias("TraceIdx"), *[F.col(c).cast(precision).cast("double").alias(c) for c in ("X", "Y")]).where(fine("X") & fine("Y"))
    points = points.select(key, F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0")).where(fine("x0") & fine("y0"))
    n = traces.count()
    if k > n:
        raise ValueError(f"{k} neighbours wanted of {n} traces")
    if strategy == "auto":
        strategy = "broadcast" if n <= BROADCAST else "grid"
    if strategy == "broadcast":
        return _sent(points, traces, key, k)
    if strategy == "grid":
        return _grid(points, traces, key, k, n)
    return _exact(points, traces, key, k)
