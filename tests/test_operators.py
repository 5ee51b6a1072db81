import csv
import os
import random
import xml.etree.ElementTree as ET
import zipfile

import pytest

from lithoflow.operators import knn, sinks
from lithoflow.operators.columns import composite_key, quantised, to_wide
from lithoflow.operators.gather import check_gathered, id_ranges, trace_gather
from lithoflow.operators.knn import knn_join
from lithoflow.operators.presence import channel_dictionary, channel_matrix, first_wins, last_wins, presence_matrix, present_in_all, prevalence
from lithoflow.plans import encoders
from lithoflow.plans import wells as W
from lithoflow.sources.traces import read_traces

STRATEGIES = ["exact", "broadcast", "grid"]


def grid(spark, n=5):
    return spark.createDataFrame([(iy * n + ix, 10.0 * ix, 10.0 * iy) for iy in range(n) for ix in range(n)], "TraceIdx long, X double, Y double")


def near(spark, points, traces, k, strategy, **kw):
    frame = spark.createDataFrame(points, "pt long, x0 double, y0 double")
    out = {}
    for r in sorted(knn_join(frame, traces, k, strategy=strategy, **kw).collect(), key=lambda r: (r["pt"], r["rank"])):
        out.setdefault(r["pt"], []).append(r["TraceIdx"])
    return out


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_knn_ties(spark, strategy):
    got = near(spark, [(1, 10.0, 20.0), (2, 15.0, 20.0), (3, None, 1.0), (4, float("nan"), 1.0)], grid(spark), 9, strategy)
    assert got == {1: [11, 6, 10, 12, 16, 5, 7, 15, 17], 2: [11, 12, 6, 7, 16, 17, 10, 13, 5]}


@pytest.mark.parametrize("strategy", STRATEGIES[1:])
def test_knn_as_the_exact_one(spark, monkeypatch, strategy):
    monkeypatch.setattr(knn, "FEW", 3)
    r = random.Random(1)
    traces = spark.createDataFrame([(i, 600000 + r.uniform(0, 900), 4.2e6 + r.choice([r.uniform(0, 20), r.uniform(0, 900)])) for i in range(700)] + [(900, 600000.0, 4.2e6), (901, 600000.0, 4.2e6)], "TraceIdx long, X double, Y double")
    points = [(i, 600000 + r.uniform(-300, 1200), 4.2e6 + r.uniform(-300, 1200)) for i in range(50)] + [(99, 7e5, 5e6)]
    assert near(spark, points, traces, 9, strategy) == near(spark, points, traces, 9, "exact")


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_knn_edges(spark, strategy):
    with pytest.raises(ValueError):
        near(spark, [(1, 0.0, 0.0)], grid(spark), 26, strategy)
    assert near(spark, [], grid(spark), 3, strategy) == {}
    same = spark.createDataFrame([(i, 5.0, 5.0) for i in (3, 1, 2)], "TraceIdx long, X double, Y double")
    assert near(spark, [(1, 0.0, 0.0)], same, 2, strategy) == {1: [1, 2]}


def test_stray_traces_leave_cells_small(spark, monkeypatch):
    monkeypatch.setattr(knn, "FEW", 3)
    r = random.Random(2)
    rows = [(i, 592331 + r.uniform(0, 1000), 4212564 + r.uniform(0, 1000)) for i in range(600)] + [(900, 0.0, 0.0)]
    traces = spark.createDataFrame(rows, "TraceIdx long, X double, Y double")
    points = [(i, 592331 + r.uniform(0, 1000), 4212564 + r.uniform(0, 1000)) for i in range(20)]
    sizes = []
    keep = knn.math.sqrt
    monkeypatch.setattr(knn.math, "sqrt", lambda x: sizes.append(keep(x)) or keep(x))
    got = near(spark, points, traces, 9, "grid")
    monkeypatch.undo()
    assert max(sizes) < 400 and got == near(spark, points, traces, 9, "exact")


def test_limits_are_errors(spark):
    from lithoflow import durable
    from lithoflow.operators.presence import column_values

    facts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "r string, c string")
    assert column_values(facts, "c") == ["x", "y"]
    with pytest.raises(ValueError):
        column_values(facts, "c", 1)
    assert durable.local_folder("local[4]")
    with pytest.raises(RuntimeError):
        durable.local_folder("spark://host:7077")


def test_precision(spark):
    traces = spark.createDataFrame([(0, 592331.03, 4212564.3), (1, 592331.0, 4212564.5)], "TraceIdx long, X double, Y double")
    assert near(spark, [(1, 592331.0, 4212564.5)], traces, 2, "exact") == {1: [0, 1]}  # both are the same in single precision
    assert near(spark, [(1, 592331.0, 4212564.5)], traces, 2, "exact", precision="double") == {1: [1, 0]}
    frame = spark.createDataFrame([(4212564.3,)], "y double")
    assert frame.select(quantised("y")).first()[0] == 4212564.5


def test_presence(spark):
    roster = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file string")
    facts = spark.createDataFrame([("f1", "AC"), ("f1", "AC"), ("f2", "GR"), ("f1", "a.b"), ("f9", "ZZ"), ("f2", None)], "file string, curve string")
    got = presence_matrix(roster, facts, "file", "curve")
    assert got.columns == ["file", "AC", "GR", "ZZ", "a.b"] and dict(got.dtypes)["AC"] == "int"
    assert {tuple(r) for r in got.collect()} == {("f1", 1, 0, 0, 1), ("f2", 0, 1, 0, 0), ("f3", 0, 0, 0, 0)}
    assert {tuple(r) for r in prevalence(roster, facts, "file", "curve").collect()} == {("AC", 3, 1), ("GR", 3, 1), ("a.b", 3, 1)}
    assert presence_matrix(roster, facts.limit(0), "file", "curve").columns == ["file"]
    assert [r["line"] for r in sinks.prevalence_report(prevalence(roster, facts, "file", "curve")).collect()] == ["AC\t3\t1", "GR\t3\t1", "a.b\t3\t1"]


def test_division_first_and_last(spark):
    facts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "w string, f string")
    assert [r[0] for r in present_in_all(facts, "w", "f", ["x", "y"]).collect()] == ["a"]
    assert present_in_all(facts, "w", "f", ["x", "y", "z"]).count() == 0 == present_in_all(facts, "w", "f", []).count()
    seen = spark.createDataFrame([("c", 2, "later", "u"), ("c", 1, None, "m"), ("d", 3, "x", None)], "k string, ord int, v string, u string")
    assert {tuple(r) for r in first_wins(seen, ["k"], ["ord"], ["v", "u"]).collect()} == {("c", None, "m"), ("d", "x", None)}
    assert {tuple(r) for r in last_wins(seen, ["k"], "ord", "v").collect()} == {("c", "later"), ("d", "x")}


def test_channels(spark):
    rows = [("w1", 0, "F1", 0, "DEPT", False, None, "m"), ("w1", 0, "F1", 1, "IMG", True, None, None), ("w1", 1, "F1", 0, "DEPT", False, "Depth", "m"), ("w1", 1, "F1", 1, "GR", False, "Gamma", "gAPI"), ("w2", 2, "F2", 0, "IMG", True, None, None)]
    channels = spark.createDataFrame(rows, "well string, file_ord int, frame string, ord int, channel string, is_array boolean, long_name string, units string")
    assert [tuple(r) for r in channel_dictionary(channels, ["file_ord", "ord"]).collect()] == [("DEPT", "", "m"), ("GR", "Gamma", "gAPI")]
    got = channel_matrix(channels)
    assert got.columns == ["Well_Frame Name", "DEPT", "GR"] and [tuple(r) for r in got.collect()] == [("w1_F1", 1, 1)]


def test_gather(spark):
    lists = spark.createDataFrame([("w", 1, 7), ("w", 2, 3), ("w", 3, 7)], "well string, ord int, TraceIdx long")
    volume = spark.createDataFrame([(3, [1.0, 2.0]), (7, [3.0]), (9, [])], "TraceIdx long, samples array<float>")
    wide = to_wide(trace_gather(lists, volume), "samples", 2, ["ord", "TraceIdx"])
    assert [tuple(r) for r in wide.orderBy("ord").collect()] == [(1, 7, 3.0, None), (2, 3, 1.0, 2.0), (3, 7, 3.0, None)]
    assert id_ranges(lists, gap=4) == [(0, 8)] and id_ranges(lists, gap=1, most=1) is None
    with pytest.raises(IndexError):
        check_gathered(trace_gather(lists, volume.where("TraceIdx = 3")))
    assert spark.range(1).selectExpr("'a' as x", "'b' as y").select(composite_key("x", "y")).first()[0] == "a_b"


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("井", 1, 1.5, None), ("b<&>", 2, -2.0, "x")], "name string, n int, v double, note string")
    path = sinks.write_small_csv(frame.orderBy("n"), str(tmp_path / "sub" / "a.csv"), bom=True)
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbf")
    assert list(csv.reader(open(path, encoding="utf-8-sig"))) == [["name", "n", "v", "note"], ["井", "1", "1.5", ""], ["b<&>", "2", "-2.0", "x"]]
    sheet = zipfile.ZipFile(sinks.write_xlsx(frame.orderBy("n"), str(tmp_path / "a.xlsx"))).read("xl/worksheets/sheet1.xml")
    cells = [[("".join(c.itertext())) for c in row] for row in ET.fromstring(sheet)[0]]
    assert cells == [["name", "n", "v", "note"], ["井", "1", "1.5"], ["b<&>", "2", "-2.0", "x"]]
    assert os.path.getsize(sinks.render_table(frame, str(tmp_path / "t.png"))) > 100
    lists = spark.createDataFrame([("imaging", "a b", 2, 5), ("imaging", "a b", 1, 9)], "kind string, well string, ord int, TraceIdx long")
    out = sinks.write_per_well(lists, [("imaging", "a b"), ("logging", "none")], str(tmp_path / "wells"))
    assert open(f"{out}/imaging/a b_traces.csv").read() == "TraceIdx\n9\n5\n"
    assert open(f"{out}/logging/none_traces.csv").read() == "TraceIdx\n"
    folder = sinks.write_frame(spark.createDataFrame([(1, [1.0], 2.0)], "SERIAL long, IMG array<double>, GR double"), str(tmp_path), "w", "f.x.dlis", 0, "F1")
    assert folder.endswith("w/f/0/F1") and spark.read.csv(folder, header=True).columns == ["SERIAL", "GR"]


def test_wells_to_cubes(spark, tmp_path):
    dev, log = tmp_path / "dev", tmp_path / "log"
    dev.mkdir()
    log.mkdir()
    (dev / "d1.dat").write_text("Well\n# MD X Y\n100 10.0 20.0\n110 10.5 bad\n120 30 20\n")
    (dev / "d2.txt").write_text("lists a well without a .dat file")
    (log / "d1.Las").write_text("~Parameter\nXCRD 0\nYCRD 0\n")
    (log / "l1.Las").write_text("~Parameter\nXCRD 15\nYCRD 20\n")
    (log / "l2.las").write_text("~Parameter\nXCRD 15\nYCRD 20\n")
    (log / "l3.Las").write_text("~Other\n")
    csv_path = tmp_path / "h.csv"
    csv_path.write_text("TraceIdx,X,Y\n" + "".join(f"{iy * 5 + ix},{10 * ix},{10 * iy}\n" for iy in range(5) for ix in range(5)))
    traces = read_traces(spark, str(csv_path))
    lists = W.well_traces(spark, str(dev), str(log), {"i1": (10, 20)}, traces).cache()
    got = {}
    for r in sorted(lists.collect(), key=lambda r: (r["well"], r["ord"])):
        got.setdefault((r["kind"], r["well"]), []).append(r["TraceIdx"])
    assert got == {("deviated", "d1"): [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19], ("logging", "l1"): [11, 12, 6, 7, 16, 17, 10, 13, 5], ("imaging", "i1"): [11, 6, 10, 12, 16, 5, 7, 15, 17]}
    volume = str(tmp_path / "v.sgy")
    encoders.segy(volume, [[i, i + 0.5] for i in range(25)])
    cube = W.trace_cubes(spark, lists, volume)
    assert cube.count() == lists.count() and all(list(r["samples"]) == [r["TraceIdx"], r["TraceIdx"] + 0.5] for r in cube.collect())
    roster = W.well_roster(spark, str(dev), str(log), {"i1": (10, 20)})
    assert {tuple(r) for r in roster.collect()} == {("deviated", "d1"), ("deviated", "d2"), ("logging", "l1"), ("logging", "l3"), ("imaging", "i1")}
    assert {tuple(r) for r in W.list_sizes(roster, lists).collect()} == {("deviated", "d1", 15), ("deviated", "d2", 0), ("logging", "l1", 9), ("logging", "l3", 0), ("imaging", "i1", 9)}
    assert {r["file"] for r in W.well_diagnostics(spark, str(dev), str(log)).collect()} == {"d2.dat", "l3.Las"}
    out = W.export_lists(spark, roster, lists, str(tmp_path / "out"))
    W.export_cubes(spark, roster, lists, volume, out)
    rows = lambda *at: list(csv.reader(open(os.path.join(out, *at))))
    assert rows("logging", "l1_traces.csv") == [["TraceIdx"], *([str(t)] for t in (11, 12, 6, 7, 16, 17, 10, 13, 5))]
    assert rows("imaging", "i1_cube.csv")[:3] == [["TraceIdx", "S0", "S1"], ["11", "11.0", "11.5"], ["6", "6.0", "6.5"]]
    assert rows("deviated", "d2_traces.csv") == [["TraceIdx"]] and rows("logging", "l3_cube.csv") == [["TraceIdx", "S0", "S1"]]
    encoders.segy(volume, [[i, i + 0.5] for i in range(10)])
    with pytest.raises(IndexError):
        W.trace_cubes(spark, lists, volume)


def test_folders_and_curves(spark, tmp_path):
    for folder, names in {"测井": ["a.las", "b.las", "x.cfg"], "井斜": ["a.dat"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("")
    folders = ["测井", "井斜", "时深"]
    got = W.folder_matrix(spark, str(tmp_path), folders)
    assert got.columns == ["folder", "a", "b"] and {tuple(r) for r in got.collect()} == {("测井", 1, 1), ("井斜", 1, 0), ("时深", 0, 0)}
    assert W.wells_in_all(spark, str(tmp_path), folders).count() == 0
    (tmp_path / "时深").mkdir()
    (tmp_path / "时深" / "a.txt").write_text("")
    assert [r[0] for r in W.wells_in_all(spark, str(tmp_path), folders).collect()] == ["a"]
    (tmp_path / "测井" / "a.las").write_text("~C\nAC.X\nGR.Y\n")
    roster, facts = W.curve_facts(spark, str(tmp_path / "测井"))
    assert {tuple(r) for r in presence_matrix(roster, facts, "file", "curve").collect()} == {("a.las", 1, 1), ("b.las", 0, 0)}
    counted = W.export_curve_matrix(spark, str(tmp_path / "测井"), str(tmp_path / "curves.xlsx"))
    assert {tuple(r) for r in counted.collect()} == {("AC", 2, 1), ("GR", 2, 1)} and zipfile.is_zipfile(tmp_path / "curves.xlsx")


def test_frames_of_wells(spark, tmp_path):
    from lithoflow.plans import frames as P

    dept, gr, img = ("DEPT", 7, [1], None, "m"), ("GR", 2, [1], "Gamma", "gAPI"), ("IMG", 16, [2], None, None)
    for name in ("w1", "w2"):
        (tmp_path / name).mkdir()
    encoders.dlis(str(tmp_path / "w1" / "a.dlis"), [[("F1", [dept, img], [[1.0, [1, 2]]])]])
    encoders.dlis(str(tmp_path / "w1" / "b.DLIS"), [[("F1", [("DEPT", 7, [1], "Depth", "ft"), gr], [[2.0, 0.5], [3.0, 1.5]])]])
    encoders.dlis(str(tmp_path / "w2" / "c.dlis"), [[("F2", [img], [[[1, 2]]])]])
    (tmp_path / "w2" / "no.txt").write_text("x")
    wells = {"w1": str(tmp_path / "w1"), "w2": str(tmp_path / "w2")}
    dictionary, matrix = P.export_channels(spark, wells, str(tmp_path / "d.csv"), str(tmp_path / "m.csv"))
    rows = lambda p: list(csv.reader(open(p, encoding="utf-8-sig")))
    assert rows(dictionary) == [["Channel Name", "Long Name", "Unit"], ["DEPT", "", "m"], ["GR", "Gamma", "gAPI"]]
    assert rows(matrix) == [["Well_Frame Name", "DEPT", "GR"], ["w1_F1", "1", "1"]]
    out = P.export_frames(spark, wells, str(tmp_path / "out"))
    tables = {os.path.relpath(p, tmp_path / "out"): sorted(map(tuple, spark.read.csv(p, header=True, inferSchema=True).collect())) for p in out if not p.endswith("F2")}
    assert tables == {"w1/a/0/F1": [(1, 1.0)], "w1/b/0/F1": [(1, 2.0, 0.5), (2, 3.0, 1.5)]}
    assert any(p.endswith("w2/c/0/F2") for p in out)
    assert P.well_channels(spark, {}).count() == 0
