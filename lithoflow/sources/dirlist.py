"""Directory listings as a data source: names in folders, empty files and sub-folders included."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folder string, name string, is_dir boolean"


class _Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class _Reader(DataSourceReader):
    def __init__(self, folders: list[str]):
        self.folders = folders

    def partitions(self):
        return [_Folder(f) for f in self.folders]

    def read(self, partition):
        if partition is None or not os.path.isdir(partition.folder):
            return
        with os.scandir(partition.folder) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                yield partition.folder, e.name, e.is_dir()


class DirList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dirlist"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader([f for f in self.options.get("folders", self.options.get("path", "")).split("\n") if f])


def list_dirs(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(folder, name, is_dir) of all entries, one task a folder; a missing folder has no rows.

    Folders must be on a file system that executors mount; their listing is not bounded by the driver's memory.
    """
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(DirList)
    return spark.read.format("dirlist").option("folders", "\n".join(folders)).load()


def missing_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(folder, stage, message) of folders that have no entry; an empty folder is named too."""
    roster = spark.createDataFrame([(f,) for f in folders], "folder string")
    gone = roster.join(list_dirs(spark, folders).select("folder").distinct(), "folder", "left_anti")
    return gone.select("folder", F.lit("list").alias("stage"), F.lit("missing or empty").alias("message"))
