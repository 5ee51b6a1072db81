"""Queries that read generated well files: LAS, deviation, trace headers, SEG-Y and DLIS, from listing to cubes.

The files are small and written by the driver into the folder that executors share, once a session; what each query
must return is known, so its SQL is a list of values.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.durable import local_folder
from lithoflow.operators.columns import scalar_columns, to_wide
from lithoflow.operators.presence import channel_dictionary, channel_matrix, presence_matrix, prevalence
from lithoflow.plans import encoders, frames, wells
from lithoflow.sources.deviation import deviation_diagnostics, deviation_points
from lithoflow.sources.dirlist import list_dirs, missing_folders
from lithoflow.sources.dlis import read_dlis_channels, read_dlis_frame
from lithoflow.sources.las import curve_names, well_coordinates
from lithoflow.sources.segy import read_segy, sample_count
from lithoflow.sources.textlines import read_lines
from lithoflow.sources.traces import read_traces

LAS = """~Version
~Curve Information
#MNEM.UNIT : desc
DEPT.M : depth
 AC .US/M : sonic
no dot line
.X : empty prefix
AC.US/M : repeat
~Curve again
GR.API : gamma
~Parameter Information
XCRD.M 592331.25 : x
YCRD.M -5 : y
YCRD.M none : y
XCRD YCRD {x}
~ASCII
1.0 2.0
"""
SURVEY = "Well deviation\n# MD  X  Y\n100 10.0 20.0\n\n110 10.5 bad\n120 30 20\n130 11.0\n"
DEPT, GR, IMG = ("DEPT", 7, [1], None, "m"), ("GR", 2, [1], "Gamma", "gAPI"), ("IMG", 16, [2, 2], "Image", None)
SAMPLES = 3

_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of the generated files: `dev`, `log`, `enc`, `dlis/w1`, `dlis/w2`, `headers.csv` and `volume.sgy`."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        shared = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark.sparkContext.master)
        at = os.path.join(shared.removeprefix("file:"), f"lithoflow-files-{uuid.uuid4().hex}")
        for name in ("dev", "log/sub", "enc", "dlis/w1", "dlis/w2"):
            os.makedirs(os.path.join(at, name))
        texts = {
            "dev/d1.dat": SURVEY,
            "dev/d2.txt": "names a well without a .dat file",
            "dev/d3.dat": "Well deviation\n# MD X Y\n1 2 3\n1 2 3 4\n",
            "dev/d4.dat": "one line",
            "dev/x.CFG": "",
            "log/d1.Las": LAS.format(x="0"),
            "log/l1.Las": LAS.format(x="15").replace("YCRD.M -5", "YCRD.M 20"),
            "log/l2.las": "~C\nSP.MV\n",
            "log/l3.Las": "~Other\n",
            "log/l4.Las": "",
            "headers.csv": "TraceIdx,X,Y,extra\n" + "".join(f"{iy * 5 + ix},{10 * ix},{10 * iy},z\n" for iy in range(5) for ix in range(5)),
        }
        for name, text in texts.items():
            with open(os.path.join(at, name), "w", encoding="utf-8", newline="") as f:
                f.write(text)
        for name, data in {"gb.txt": "井斜\n车15".encode("gb18030"), "mark.txt": "﻿é\r\nb".encode(), "plain.txt": b"a\rb\n"}.items():
            with open(os.path.join(at, "enc", name), "wb") as f:
                f.write(data)
        encoders.segy(os.path.join(at, "volume.sgy"), [[i, i + 0.5, -i] for i in range(25)], 1)
        encoders.dlis(os.path.join(at, "dlis/w1/a.DLIS"), [[("F1", [DEPT, IMG], [[1.0, [1, 2, 3, 4]], [2.0, [5, 6, 7, 8]]])], [("F1", [DEPT], [[9.0]])]])
        encoders.dlis(os.path.join(at, "dlis/w1/b.dlis"), [[("F1", [("DEPT", 7, [1], "Depth", "ft"), GR], [[3.0, 0.5]])]])
        encoders.dlis(os.path.join(at, "dlis/w2/c.dlis"), [[("F2", [IMG], [])]])
        _made[app] = at
    return _made[app]


def _at(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}"


def _las(spark: SparkSession) -> DataFrame:
    return read_lines(spark, _at(spark, "log"), "utf-8", "*.[lL][aA][sS]")


def _dlis(spark: SparkSession) -> DataFrame:
    return frames.well_channels(spark, {"w1": _at(spark, "dlis/w1"), "w2": _at(spark, "dlis/w2")})


def _lists(spark: SparkSession) -> DataFrame:
    return wells.well_traces(spark, _at(spark, "dev"), _at(spark, "log"), {"i1": (10, 20)}, read_traces(spark, _at(spark, "headers.csv")))


def _roster(spark: SparkSession) -> DataFrame:
    return wells.well_roster(spark, _at(spark, "dev"), _at(spark, "log"), {"i1": (10, 20)})


def list_folder(spark: SparkSession, sf: str) -> DataFrame:
    return list_dirs(spark, [_at(spark, "dev"), _at(spark, "log"), _at(spark, "none")]).select("name", "is_dir")


def gone_folders(spark: SparkSession, sf: str) -> DataFrame:
    return missing_folders(spark, [_at(spark, "dev"), _at(spark, "none")]).select(F.substring_index("folder", "/", -1).alias("folder"), "stage", "message")


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read_lines(spark, _at(spark, "enc")).select("file", "pos", "line")


def las_curves(spark: SparkSession, sf: str) -> DataFrame:
    return curve_names(_las(spark)).select("file", "curve")


def las_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return well_coordinates(read_lines(spark, _at(spark, "log"), glob="*.Las")).select("file", "x", "y")


def curve_matrix(spark: SparkSession, sf: str) -> DataFrame:
    roster, facts = wells.curve_facts(spark, _at(spark, "log"))
    return presence_matrix(roster, facts, "file", "curve", ["AC", "DEPT", "GR", "SP"])


def curve_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return prevalence(*wells.curve_facts(spark, _at(spark, "log"), strict=True), "file", "curve")


def survey_points(spark: SparkSession, sf: str) -> DataFrame:
    return deviation_points(read_lines(spark, _at(spark, "dev"), glob="*.dat")).select("file", "pos", "x", "y")


def survey_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return deviation_diagnostics(read_lines(spark, _at(spark, "dev"), glob="*.dat"))


def trace_headers(spark: SparkSession, sf: str) -> DataFrame:
    return read_traces(spark, _at(spark, "headers.csv"))


def segy_traces(spark: SparkSession, sf: str) -> DataFrame:
    path = _at(spark, "volume.sgy")
    return to_wide(read_segy(spark, path, [(2, 4), (24, 99)]), "samples", sample_count(path), ["TraceIdx"])


def dlis_channels(spark: SparkSession, sf: str) -> DataFrame:
    return read_dlis_channels(spark, _at(spark, "dlis/w1")).select("file", "logical_file", "frame", "ord", "channel", "is_array", "long_name", "units")


def dlis_frame(spark: SparkSession, sf: str) -> DataFrame:
    return scalar_columns(read_dlis_frame(spark, _at(spark, "dlis/w1/a.DLIS"), "F1"))


def dlis_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return channel_dictionary(_dlis(spark), frames.SIGHTING)


def dlis_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return channel_matrix(_dlis(spark))


def folder_wells(spark: SparkSession, sf: str) -> DataFrame:
    return wells.folder_matrix(spark, folder(spark), ["dev", "enc", "none"])


def wells_in_all_folders(spark: SparkSession, sf: str) -> DataFrame:
    return wells.wells_in_all(spark, folder(spark), ["dev", "log"])


def well_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark).select("kind", "well", F.col("ord").cast("bigint").alias("ord"), "TraceIdx")


def well_list_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return wells.list_sizes(_roster(spark), _lists(spark))


def well_problems(spark: SparkSession, sf: str) -> DataFrame:
    return wells.well_diagnostics(spark, _at(spark, "dev"), _at(spark, "log"))


def well_cubes(spark: SparkSession, sf: str) -> DataFrame:
    """The cubes as they are written for each well, read again with the wells' names from the files'."""
    out = _at(spark, f"cubes-{uuid.uuid4().hex}")
    wells.export_cubes(spark, _roster(spark), _lists(spark), _at(spark, "volume.sgy"), out)
    written = spark.read.option("recursiveFileLookup", True).csv(out, header=True, schema="TraceIdx bigint, S0 double, S1 double, S2 double")
    name = F.col("_metadata.file_name")
    return written.select(wells.well_of(name, "_cube.csv").alias("well"), "TraceIdx", "S0", "S1", "S2")


def _values(columns: str, rows: list[tuple], types: str = "") -> str:
    """SELECT of these rows; types: of the columns, by place."""
    names, kinds = columns.split(), types.split() or ["VARCHAR"] * len(columns.split())
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    cast = ", ".join(f'CAST(c{i} AS {k}) AS "{n.replace("~", " ")}"' for i, (n, k) in enumerate(zip(names, kinds, strict=True)))
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) v({', '.join(f'c{i}' for i in range(len(names)))})"


_D1 = [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
_L1, _I1 = [11, 12, 6, 7, 16, 17, 10, 13, 5], [11, 6, 10, 12, 16, 5, 7, 15, 17]
_KINDS = [("deviated", "d1", _D1), ("logging", "l1", _L1), ("imaging", "i1", _I1)]
_NAMES = ["d1.dat", "d2.txt", "d3.dat", "d4.dat", "x.CFG", "d1.Las", "l1.Las", "l2.las", "l3.Las", "l4.Las", "sub"]
_CURVES = ["#MNEM", "DEPT", "AC", "AC", "GR"]

SQL = {
    "list_folder": _values("name is_dir", [(n, n == "sub") for n in _NAMES], "VARCHAR BOOLEAN"),
    "gone_folders": _values("folder stage message", [("none", "list", "missing or empty")]),
    "text_lines": _values("file pos line", [("gb.txt", 0, "井斜"), ("gb.txt", 1, "车15"), ("mark.txt", 0, "é"), ("mark.txt", 1, "b"), ("plain.txt", 0, "a"), ("plain.txt", 1, "b")], "VARCHAR INTEGER VARCHAR"),
    "las_curves": _values("file curve", [(f, c) for f in ("d1.Las", "l1.Las") for c in _CURVES] + [("l2.las", "SP")]),
    "las_coordinates": _values("file x y", [("d1.Las", 0, 5), ("l1.Las", 15, 20), ("l3.Las", None, None)], "VARCHAR DOUBLE DOUBLE"),
    "curve_matrix": _values("file AC DEPT GR SP", [("d1.Las", 1, 1, 1, 0), ("l1.Las", 1, 1, 1, 0), ("l2.las", 0, 0, 0, 1), ("l3.Las", 0, 0, 0, 0), ("l4.Las", 0, 0, 0, 0)], "VARCHAR INTEGER INTEGER INTEGER INTEGER"),
    "curve_prevalence": _values("curve total_rows ones", [("AC", 5, 2), ("DEPT", 5, 2), ("GR", 5, 2), ("SP", 5, 1)], "VARCHAR BIGINT BIGINT"),
    "survey_points": _values("file pos x y", [("d1.dat", 2, 10, 20), ("d1.dat", 5, 30, 20)], "VARCHAR INTEGER DOUBLE DOUBLE"),
    "survey_diagnostics": _values("file stage message", [(f, "deviation", "no usable row") for f in ("d3.dat", "d4.dat")]),
    "trace_headers": "SELECT iy * 5 + ix AS \"TraceIdx\", CAST(10 * ix AS DOUBLE) AS \"X\", CAST(10 * iy AS DOUBLE) AS \"Y\" FROM range(5) a(ix), range(5) b(iy)",
    "segy_traces": 'SELECT i AS "TraceIdx", CAST(i AS FLOAT) AS "S0", CAST(i + 0.5 AS FLOAT) AS "S1", CAST(-i AS FLOAT) AS "S2" FROM (VALUES (2::BIGINT), (3), (24)) v(i)',
    "dlis_channels": _values(
        "file logical_file frame ord channel is_array long_name units",
        [("a.DLIS", 0, "F1", 0, "DEPT", False, None, "m"), ("a.DLIS", 0, "F1", 1, "IMG", True, "Image", None), ("a.DLIS", 1, "F1", 0, "DEPT", False, None, "m"), ("b.dlis", 0, "F1", 0, "DEPT", False, "Depth", "ft"), ("b.dlis", 0, "F1", 1, "GR", False, "Gamma", "gAPI")],
        "VARCHAR INTEGER VARCHAR INTEGER VARCHAR BOOLEAN VARCHAR VARCHAR",
    ),
    "dlis_frame": _values("SERIAL DEPT", [(1, 1.0), (2, 2.0)], "BIGINT DOUBLE"),
    "dlis_dictionary": _values("Channel~Name Long~Name Unit", [("DEPT", "", "m"), ("GR", "Gamma", "gAPI")]),
    "dlis_matrix": _values("Well_Frame~Name DEPT GR", [("w1_F1", 1, 1)], "VARCHAR INTEGER INTEGER"),
    "folder_wells": _values("folder d1 d2 d3 d4 gb mark plain", [("dev", 1, 1, 1, 1, 0, 0, 0), ("enc", 0, 0, 0, 0, 1, 1, 1), ("none", 0, 0, 0, 0, 0, 0, 0)], "VARCHAR" + " INTEGER" * 7),
    "wells_in_all_folders": _values("well", [("d1",)]),
    "well_lists": _values("kind well ord TraceIdx", [(k, w, i + 1, t) for k, w, ts in _KINDS for i, t in enumerate(ts)], "VARCHAR VARCHAR BIGINT BIGINT"),
    "well_list_sizes": _values("kind well traces", [("deviated", "d1", 15), *(("deviated", w, 0) for w in ("d2", "d3", "d4", "x")), ("logging", "l1", 9), ("logging", "l3", 0), ("logging", "l4", 0), ("imaging", "i1", 9)], "VARCHAR VARCHAR BIGINT"),
    "well_problems": _values("file stage message", [("d2.dat", "read", "no such file, or an empty one"), ("x.dat", "read", "no such file, or an empty one"), ("l4.Las", "read", "no such file, or an empty one"), ("d3.dat", "deviation", "no usable row"), ("d4.dat", "deviation", "no usable row"), ("l3.Las", "coordinates", "no XCRD or YCRD value")]),
    "well_cubes": _values("well TraceIdx S0 S1 S2", [(w, t, t, t + 0.5, -t) for _, w, ts in _KINDS for t in ts], "VARCHAR BIGINT DOUBLE DOUBLE DOUBLE"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
