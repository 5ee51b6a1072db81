"""What the operators of this subpackage share: Arrow row mapping, durable tables, table paths."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.durable import durable, local_folder

__all__ = ["BATCH_BYTES", "CHUNK_BYTES", "Memo", "as_binary", "bounded", "chunks", "durable", "map_texts", "saved", "scratch", "shared_dir", "table"]

#: Text that one call of a row function gets at most, unless a single text is longer.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch that goes to Python at most, unless a single row is longer. Spark's own limits are 64 MB and 10,000 rows.
BATCH_BYTES = 8 << 20
#: The session's setting of that.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and the master is local, as in tests."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        sc.setCheckpointDir(local_folder(sc.master))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


#: Paths that the innermost scratch deletes.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were saved inside, at its end; one that is needed later is saved with stays=True."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, stays: bool = False) -> DataFrame:
    """As durable, in Parquet: columns can be pruned and are compressed. The files stay in the shared folder, unless in a scratch."""
    path = f"{shared_dir(df.sparkSession)}/lithoflow-{uuid.uuid4().hex}"
    paths = _SCRATCH.get()
    if paths is not None and not stays:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """df itself. Its session from now on has Arrow batches of at most BATCH_BYTES; a smaller limit stays.

    Both the executor and its Python worker hold whole batches, twice while a buffer grows or the next one arrives.
    The limit is read when a plan runs, so it can't be set for one plan alone; results don't depend on it.
    """
    conf = df.sparkSession.conf
    now = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", (conf.get(BATCH_SETTING, None) or "").lower())
    if not now or int(now[1]) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(now[2][:1], 0) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def as_binary(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together; a single larger row stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[bytes | None]], list]],
) -> DataFrame:
    """keep's columns and new fields, made from whole texts by make()'s function: UTF-8 texts to one list per field.

    make runs once per task, so that models and caches are built on the executor.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = bounded(df).select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.select(*[F.col(f"`{k}`") for k in keep]).schema.fields, *[T.StructField(n, t) for n, t in fields]])
    kept, arrow = len(keep), to_arrow_schema(schema, timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            texts = as_binary(batch.column(kept))
            for a, b in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                made = f(texts.slice(a, b - a).to_pylist())
                arrays = [batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(kept)]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(kept + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


class Memo:
    """A memo of bounded size: `known` becomes `older` at `most` entries; entries come back from there when used."""

    def __init__(self, most: int):
        self.most = most
        self.known: dict = {}  # plain dicts: a set's difference to them takes the set's size, not theirs
        self.older: dict = {}

    def fill(self, keys: set, make: Callable[[list], list]) -> dict:
        """A dict that holds all keys; make gives the values of those that were not known."""
        new = keys.difference(self.known)
        if len(self.known) + len(new) > self.most and self.known:
            self.older, self.known, new = self.known, {}, keys
        if new and self.older:
            older = self.older
            self.known.update([(k, older[k]) for k in new if k in older])
            new = new.difference(self.known)
        if new:
            new = list(new)
            self.known.update(zip(new, make(new), strict=True))
        return self.known
