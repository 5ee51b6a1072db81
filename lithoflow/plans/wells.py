"""From folders of wells to their traces and trace cubes."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoflow.functions import has_suffix, stem_first, stem_last, without
from lithoflow.operators.gather import check_gathered, id_ranges, trace_gather
from lithoflow.operators.knn import knn_join
from lithoflow.operators.columns import to_wide
from lithoflow.operators.presence import not_in, presence_matrix, present_in_all, prevalence
from lithoflow.operators.sinks import report_rows, write_per_well, write_xlsx
from lithoflow.sources.deviation import deviation_diagnostics, deviation_points
from lithoflow.sources.dirlist import list_dirs, missing_folders
from lithoflow.sources.las import coordinate_diagnostics, well_coordinates
from lithoflow.sources.segy import read_segy, sample_count
from lithoflow.sources.textlines import read_lines

NEIGHBOURS = 9


def well_of(file: Column | str, suffix: str = "_traces.csv") -> Column:
    """The well of a written file's name."""
    return without(file, suffix)


def deviated_roster(spark: SparkSession, folder: str) -> DataFrame:
    """Wells named by any entry of the folder, by what stands before the first dot."""
    return list_dirs(spark, [folder]).select(stem_first("name").alias("well")).distinct()


def logging_roster(spark: SparkSession, folder: str, deviated: DataFrame, suffix: str = ".Las", any_case: bool = False) -> DataFrame:
    """Wells with a file of that suffix that are not deviated."""
    named = list_dirs(spark, [folder]).where(has_suffix("name", suffix, any_case)).select(stem_first("name").alias("well")).distinct()
    return not_in(named, deviated, "well")


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table with ord, the place of each row as given."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, ord int")


def imaging_roster(spark: SparkSession, wells: dict[str, tuple[float, float]]) -> DataFrame:
    return inline_table(spark, [(w, float(x), float(y)) for w, (x, y) in wells.items()], "well string, x0 double, y0 double")


def deviated_traces(points: DataFrame, traces: DataFrame, k: int = NEIGHBOURS, **knn) -> DataFrame:
    """(well, kind, ord, TraceIdx): the distinct neighbours of all of a well's points (well, pos, x, y), ascending."""
    named = points.select(F.struct("well", "pos").alias("pt"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    keyed = named.withColumn("pt", F.to_json("pt"))
    near = knn_join(keyed, traces, k, "pt", **knn).select(F.get_json_object("pt", "$.well").alias("well"), "TraceIdx").distinct()
    order = Window.partitionBy("well").orderBy("TraceIdx")
    return near.select("well", F.lit("deviated").alias("kind"), F.row_number().over(order).alias("ord"), "TraceIdx")


def point_traces(points: DataFrame, traces: DataFrame, kind: str, k: int = NEIGHBOURS, **knn) -> DataFrame:
    """(well, kind, ord, TraceIdx): the neighbours of a well's one point (well, x, y) in order of distance."""
    named = points.where("x is not null and y is not null").select("well", F.col("x").alias("x0"), F.col("y").alias("y0"))
    return knn_join(named, traces, k, "well", **knn).select("well", F.lit(kind).alias("kind"), F.col("rank").alias("ord"), "TraceIdx")


def well_traces(spark: SparkSession, deviation: str, logging: str, imaging: dict[str, tuple[float, float]], traces: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Trace lists of all wells of the three kinds. Files are read as well.dat and well.Las; wells without a usable file have no row here, and one in well_diagnostics."""
    deviated = deviated_roster(spark, deviation)
    logged = logging_roster(spark, logging, deviated)
    points = _lines(spark, deviation, "*.dat").join(deviated, "well")
    dev = deviated_traces(deviation_points(points, ["well"]), traces, k)
    at = well_coordinates(_lines(spark, logging, "*.Las").join(logged, "well"), key=["well"])
    img = imaging_roster(spark, imaging).select("well", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return dev.unionByName(point_traces(at, traces, "logging", k)).unionByName(point_traces(img, traces, "imaging", k))


def well_roster(spark: SparkSession, deviation: str, logging: str, imaging: dict[str, tuple[float, float]]) -> DataFrame:
    """(kind, well) of all wells that well_traces is asked for, whether or not they have a file."""
    deviated = deviated_roster(spark, deviation)
    logged = logging_roster(spark, logging, deviated)
    img = imaging_roster(spark, imaging)
    return reduce(DataFrame.unionByName, [r.select(F.lit(kind).alias("kind"), "well") for kind, r in (("deviated", deviated), ("logging", logged), ("imaging", img))])


def well_diagnostics(spark: SparkSession, deviation: str, logging: str) -> DataFrame:
    """(file, stage, message) of wells without a trace list: of no file with the name that is read, of no usable row, of no coordinate."""
    deviated = deviated_roster(spark, deviation)
    logged = logging_roster(spark, logging, deviated)
    out = missing_folders(spark, [deviation, logging]).select(F.col("folder").alias("file"), "stage", "message")
    for roster, folder, suffix, tell in ((deviated, deviation, ".dat", _no_point), (logged, logging, ".Las", _no_coordinate)):
        named = F.concat("well", F.lit(suffix)).alias("file")
        lines = _lines(spark, folder, f"*{suffix}")
        lost = not_in(roster, lines, "well").select(named, F.lit("read").alias("stage"), F.lit("no such file, or an empty one").alias("message"))
        out = out.unionByName(lost).unionByName(tell(lines.join(roster, "well")).select(named, "stage", "message"))
    return out


def _no_point(lines: DataFrame) -> DataFrame:
    return deviation_diagnostics(lines, ["well"])


def _no_coordinate(lines: DataFrame) -> DataFrame:
    return coordinate_diagnostics(well_coordinates(lines, key=["well"]), "well").withColumnRenamed("file", "well")


def list_sizes(roster: DataFrame, lists: DataFrame) -> DataFrame:
    """(kind, well, traces): the size of every well's list, 0 for wells without one."""
    n = lists.groupBy("kind", "well").agg(F.count("*").alias("traces"))
    return roster.join(n, ["kind", "well"], "left").select("kind", "well", F.coalesce("traces", F.lit(0)).alias("traces"))


def export_lists(spark: SparkSession, roster: DataFrame, lists: DataFrame, folder: str) -> str:
    """folder/kind/well_traces.csv for every well of the roster, a header alone for wells without a trace."""
    return write_per_well(lists.select("kind", "well", "ord", "TraceIdx"), _names(roster), folder)


def export_cubes(spark: SparkSession, roster: DataFrame, lists: DataFrame, segy_path: str, folder: str) -> str:
    """folder/kind/well_cube.csv for every well of the roster: TraceIdx and S0, S1 and so on, a row for each trace of its list in order."""
    wide = to_wide(trace_cubes(spark, lists, segy_path), "samples", sample_count(segy_path), ["kind", "well", "ord", "TraceIdx"])
    return write_per_well(wide, _names(roster), folder, "_cube", wide.columns[3:])


def _names(roster: DataFrame) -> list[tuple[str, str]]:
    """The roster, a report's size at most: its files are named by the driver."""
    return [tuple(r) for r in report_rows(roster.select("kind", "well"))]


def _lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    if not any(f.endswith(glob[1:]) for f in (os.listdir(folder) if os.path.isdir(folder) else [])):
        return spark.createDataFrame([], "file string, path string, pos int, line string, well string")
    return read_lines(spark, folder, glob=glob).withColumn("well", stem_first("file"))


def trace_cubes(spark: SparkSession, lists: DataFrame, segy_path: str) -> DataFrame:
    """Trace lists with samples. Only the ranges of the file that are listed are read; a trace out of range is an error."""
    volume = read_segy(spark, segy_path, id_ranges(lists))
    return check_gathered(trace_gather(lists, volume))


def folder_matrix(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Folder by well, 0/1: entries but .cfg files, by the name without the last extension; missing folders are rows of zeros."""
    facts = folder_facts(spark, root, folders)
    roster = spark.createDataFrame([(f,) for f in folders], "folder string")
    return presence_matrix(roster, facts, "folder", "well")


def folder_facts(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    listed = list_dirs(spark, [os.path.join(root, f) for f in folders]).where(~has_suffix("name", ".cfg", True))
    return listed.select(F.substring_index("folder", "/", -1).alias("folder"), stem_last("name").alias("well")).distinct()


def wells_in_all(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    return present_in_all(folder_facts(spark, root, folders), "well", "folder", folders)


def curve_facts(spark: SparkSession, folder: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(roster of .las files of any case, (file, curve) facts); empty files are on the roster."""
    from lithoflow.sources.las import curve_names

    roster = list_dirs(spark, [folder]).where(has_suffix("name", ".las", True)).select(F.col("name").alias("file"))
    facts = curve_names(read_lines(spark, folder, "utf-8", "*.[lL][aA][sS]"), strict).select("file", "curve").distinct()
    return roster, facts


def export_curve_matrix(spark: SparkSession, folder: str, path: str, strict: bool = False) -> DataFrame:
    """File by curve, 0/1, as a workbook at path; returns the curves' prevalence (curve, total_rows, ones)."""
    roster, facts = curve_facts(spark, folder, strict)
    write_xlsx(presence_matrix(roster, facts, "file", "curve").orderBy("file"), path)
    return prevalence(roster, facts, "file", "curve")
