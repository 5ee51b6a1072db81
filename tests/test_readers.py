import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoflow.functions import fields, first_number, parse_double, stem_first, stem_last, trim_ws
from lithoflow.operators.columns import scalar_columns
from lithoflow.sources import rp66
from lithoflow.sources.deviation import deviation_diagnostics, deviation_points
from lithoflow.sources.dirlist import list_dirs, missing_folders
from lithoflow.sources.dlis import read_dlis_channels, read_dlis_frame
from lithoflow.sources.las import coordinate_diagnostics, curve_names, well_coordinates
from lithoflow.sources.segy import header, read_segy, sample_count
from lithoflow.sources.textlines import read_lines, sniff
from lithoflow.plans import encoders

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
XCRD YCRD 7.5
~ASCII
1.0 2.0
"""


def value(spark, make, inputs):
    frame = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
    return [r[0] for r in frame.orderBy("i").select(make("s")).collect()]


def test_strings(spark):
    assert value(spark, trim_ws, ["　a b\t ", "\x1c x", "", None]) == ["a b", "x", "", None]
    assert value(spark, stem_last, ["a.las", "a.b.las", "a..las", ".bashrc", "..foo", "a.", "", "车15.las", "x"]) == ["a", "a.b", "a.", ".bashrc", "..foo", "a", "", "车15", "x"]
    assert value(spark, stem_first, ["a.b.c", ".x", "x"]) == ["a", "", "x"]
    assert value(spark, first_number, ["592331.25", "-5", "-5.5", ".5", "12.", "1e5", "XCRD2 .M 77.5", "none", None]) == [592331.25, 5.0, -5.5, 0.5, 12.0, 1.0, 2.0, None, None]
    assert value(spark, lambda s: first_number(s, signed=True), ["-5", "+7 x"]) == [-5.0, 7.0]
    assert value(spark, parse_double, ["1.5", " -2e3 ", "1.0d", "nan", "inf", "", "x", None, "1e999", "5."]) == [1.5, -2000.0, None, None, None, None, None, None, None, 5.0]
    assert value(spark, fields, [" a\t b　c "]) == [["a", "b", "c"]]


def test_las(spark, tmp_path):
    (tmp_path / "w1.Las").write_text(LAS)
    (tmp_path / "w2.Las").write_text("~PARAMETER\nXCRD 1\n~c\nA.B\n")
    (tmp_path / "w3.Las").write_bytes(b"")
    (tmp_path / "w4.Las").write_bytes("~C\né\ud83d".encode("utf-8", "surrogatepass") + b"\xff.x\r\nB.\r~O\nC.D".replace(b"\xff", b"\xff"))
    lines = read_lines(spark, str(tmp_path), "utf-8", "*.Las")
    got = curve_names(lines)
    assert [r["curve"] for r in got.where("file = 'w1.Las'").orderBy("pos").collect()] == ["#MNEM", "DEPT", "AC", "AC", "GR"]
    assert [r["curve"] for r in curve_names(lines, strict=True).where("file = 'w1.Las'").orderBy("pos").collect()] == ["DEPT", "AC", "AC", "GR"]
    assert got.where("file = 'w2.Las'").count() == 0
    assert [r["curve"] for r in got.where("file = 'w4.Las'").orderBy("pos").collect()] == ["é", "B"]
    at = {r["file"]: (r["x"], r["y"]) for r in well_coordinates(lines).collect()}
    assert at["w1.Las"] == (7.5, 5.0) and at["w2.Las"] == (None, None)
    assert {r["file"] for r in coordinate_diagnostics(well_coordinates(lines)).collect()} >= {"w2.Las", "w4.Las"}
    assert {r["name"] for r in list_dirs(spark, [str(tmp_path)]).collect()} == {"w1.Las", "w2.Las", "w3.Las", "w4.Las"}


def test_deviation(spark, tmp_path):
    head = "Well deviation\n"
    files = {
        "good": head + "# MD  X  Y\n100 10.0 20.0\n\n110 10.5 bad\n120 11.0\n",
        "wide": head + "# MD  X  Y\n100 10.0 20.0\n100 10.0 20.0 3\n",
        "one": "Well deviation\n",
        "blank": head + " # MD  X  Y\n100 10.0 20.0\n",
        "columns": head + "##Y MD X\r\n1.5 0 2.5\r\n3 0 nan\r\n",
        "no_x": head + "MD Y\n1 2\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.dat").write_text(text)
    lines = read_lines(spark, str(tmp_path), glob="*.dat")
    got = sorted((r["file"], r["pos"], r["x"], r["y"]) for r in deviation_points(lines).collect())
    assert got == [("columns.dat", 2, 2.5, 1.5), ("good.dat", 2, 10.0, 20.0)]
    assert {r["file"] for r in deviation_diagnostics(lines).collect()} == {"wide.dat", "one.dat", "blank.dat", "no_x.dat"}


def test_encodings(spark, tmp_path):
    assert sniff(b"abc") == "ascii" and sniff("é".encode()) == "utf-8" and sniff("车镇".encode("gb18030")) == "gb18030"
    assert sniff(b"\xef\xbb\xbfx") == "utf-8-sig" and sniff("x".encode("utf-16")) == "utf-16"
    cut = ("a" * 2047 + "é").encode()
    assert sniff(cut[:2048]) == "utf-8"
    (tmp_path / "g.txt").write_bytes("井斜\n车15".encode("gb18030"))
    (tmp_path / "late.txt").write_bytes(b"a" * 2048 + "é b".encode())
    got = {(r["file"], r["pos"]): r["line"] for r in read_lines(spark, str(tmp_path)).collect()}
    assert got["g.txt", 0] == "井斜" and got["g.txt", 1] == "车15"
    assert got["late.txt", 0] == "a" * 2048 + " b"


def test_missing_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "sub").mkdir()
    (tmp_path / "a" / "empty.las").write_bytes(b"")
    there, gone = str(tmp_path / "a"), str(tmp_path / "b")
    assert {(r["name"], r["is_dir"]) for r in list_dirs(spark, [there, gone]).collect()} == {("sub", True), ("empty.las", False)}
    assert [r["folder"] for r in missing_folders(spark, [there, gone]).collect()] == [gone]
    assert list_dirs(spark, []).count() == 0


@pytest.mark.parametrize("code", [1, 2, 3, 5, 6, 8])
def test_segy(spark, tmp_path, code):
    path = str(tmp_path / "v.sgy")
    traces = np.arange(24).reshape(6, 4) - 7.0 + (0.5 if code in (1, 5, 6) else 0)
    encoders.segy(path, traces, code, extended=1 if code == 5 else 0)
    assert sample_count(path) == 4 and header(path)["traces"] == 6
    got = {r["TraceIdx"]: list(r["samples"]) for r in read_segy(spark, path).collect()}
    assert got == {i: t.tolist() for i, t in enumerate(traces)}
    assert sorted(r["TraceIdx"] for r in read_segy(spark, path, [(1, 3), (5, 99)]).collect()) == [1, 2, 5]


def test_segy_of_an_unknown_format_is_an_error(spark, tmp_path):
    path = str(tmp_path / "v.sgy")
    encoders.segy(path, [[1.0]], 5)
    data = bytearray(open(path, "rb").read())
    struct.pack_into(">h", data, 3224, 99)
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        header(path)


DEPT, GR, IMG, TXT = ("DEPT", 7, [1], None, "m"), ("GR", 2, [1], "Gamma é", "gAPI"), ("IMG", 16, [2, 3], "Image", None), ("TXT", 20, [1], "Text", None)


@pytest.mark.parametrize("how", [{}, {"size": 12}, {"pad": True}, {"checksum": True, "size": 20, "pad": True}])
def test_dlis(spark, tmp_path, how):
    rows = [[float(i), i / 2, [i + k for k in range(6)], f"row {i}" * (1 + 40 * (i == 1))] for i in range(300)]
    encoders.dlis(str(tmp_path / "a.DLIS"), [[("F1", [DEPT, GR, IMG, TXT], rows), ("F2", [IMG], [])], [("F1", [DEPT], [[9.0]])]], **how)
    meta = [(r["logical_file"], r["frame"], r["ord"], r["channel"], r["is_array"], r["long_name"], r["units"]) for r in read_dlis_channels(spark, str(tmp_path)).orderBy("logical_file", "frame_ord", "ord").collect()]
    assert meta == [(0, "F1", 0, "DEPT", False, None, "m"), (0, "F1", 1, "GR", False, "Gamma é", "gAPI"), (0, "F1", 2, "IMG", True, "Image", None), (0, "F1", 3, "TXT", False, "Text", None), (0, "F2", 0, "IMG", True, "Image", None), (1, "F1", 0, "DEPT", False, None, "m")]
    path = str(tmp_path / "a.DLIS")
    frame = read_dlis_frame(spark, path, "F1").orderBy("SERIAL")
    assert [(r[0], r[1], r[2], list(r[3]), r[4]) for r in frame.collect()] == [(i + 1, *c) for i, c in enumerate(rows)]
    assert scalar_columns(frame).columns == ["SERIAL", "DEPT", "GR", "TXT"]
    assert read_dlis_frame(spark, path, "F2").columns == ["SERIAL", "IMG"] and read_dlis_frame(spark, path, "F2").count() == 0
    assert read_dlis_frame(spark, path, "F1", 1).collect()[0]["DEPT"] == 9.0
    with pytest.raises(ValueError):
        read_dlis_frame(spark, path, "F9")


def test_number_codes():
    c = lambda code, data: rp66.Cursor(data).value(code)
    assert c(1, struct.pack(">h", (1024 << 4) | 3)) == 4.0
    assert c(5, struct.pack(">I", encoders.ibm(-118.625))) == -118.625
    assert c(6, bytes([0x80, 0x40, 0, 0])) == 1.0
    assert c(18, b"\x81\x00") == 256 and c(18, b"\xc0\x00\x40\x00") == 16384
    assert c(21, bytes([87, 0x14, 19, 21, 20, 15, 2, 108])) == "1987-04-19T21:20:15.620"
    with pytest.raises(ValueError):
        c(99, b"\0" * 9)


def test_lines_of_a_missing_field_are_null(spark):
    frame = spark.createDataFrame([("f", 0, "x"), ("f", 1, "X Y"), ("f", 2, "1")], "file string, pos int, line string")
    assert deviation_points(frame).count() == 0
    assert frame.select(F.lit(1)).count() == 3
