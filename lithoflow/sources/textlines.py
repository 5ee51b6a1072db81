"""Lines of text files of unknown encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file from which its encoding is told.
SNIFF = 2048


def sniff(head: bytes) -> str:
    """The encoding of a file that begins so: by its mark, else the first of ASCII, UTF-8 and GB18030 that can read it."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    for name in ("ascii", "utf-8", "gb18030"):
        try:
            head.decode(name)
        except UnicodeDecodeError as e:
            # a character that the sample's end cuts is no error
            if name != "ascii" and e.end >= len(head) - 3 and e.start >= len(head) - 4 and len(head) == SNIFF:
                return name
        else:
            return name
    return "utf-8"


def read_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None, glob: str | None = None) -> DataFrame:
    """(file, path, pos, line): the lines of all files, counted from 0. Undecodable bytes are left out.

    encoding: of all files; told from each file's first 2,048 bytes if none is given. A file with no line gives one row whose
    pos and line are null, so that it stays on the roster.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")

    def decode(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in contents:
            yield pd.Series([c.decode(encoding or sniff(c[:SNIFF]), "ignore") if c is not None else None for c in column])

    text = F.pandas_udf(decode, "string")
    # universal line ends; a last line end closes a line and opens none
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    full = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    out = files.select("path", text("content").alias("text")).select("path", F.posexplode_outer(full).alias("pos", "line"))
    return out.select(F.substring_index("path", "/", -1).alias("file"), "path", "pos", "line")
