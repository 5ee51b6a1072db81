"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def local_folder(master: str) -> str:
    """A new temporary folder for a local master; a cluster's executors would not see it, so there it is an error."""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lithoflow-")


def durable(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut; the folder is spark.checkpoint.dir, a temporary one only where that is unset and the master local."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or local_folder(sc.master))
    return df.checkpoint(eager=True)
