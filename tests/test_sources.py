import json
import zipfile

import pytest
from pyspark.sql import functions as F

from waymark.operators import raster
from waymark.sources import files, sinks, stored, xlsx


def _workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["title"], ["", "code", "name of course"], ["x", "001", "First"], ["", "002", ""]])
    rows = xlsx.read_xlsx(spark, str(tmp_path))
    out = xlsx.table_below(rows, "code", {"id": ("code",), "name": ("name",)}, ("id",)).orderBy("ordinal").collect()
    assert [(r["id"], r["name"]) for r in out] == [("001", "First"), ("002", "")]
    with pytest.raises(ValueError):
        xlsx.header_row(rows, "nothing")
    with pytest.raises(ValueError):
        xlsx.map_columns(["a"], {"id": ("code",)}, ("id",))


def test_sections_merge(spark, tmp_path):
    m = lambda room: {"day": 0, "start": 540, "end": 600, "building": "1", "room": room}
    (tmp_path / "s.json").write_text(json.dumps([{"course_id": "c", "meetings": [m("101"), m("102"), m("101"), {**m("1"), "day": 2}]}, {"course_id": "d"}]))
    rows = {r["course_id"]: r for r in files.sections_json(spark, str(tmp_path / "s.json")).collect()}
    assert [x["room"] for x in rows["c"]["meetings"]] == ["101/102", "1"]
    assert rows["d"]["meetings"] == [] and rows["d"]["credit"] == 0 and rows["d"]["status"] == ""


def test_csv_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("from,to,minutes,source\na,b,3,x\na,b,4,y\nb,a,5,x\n")
    assert {(r.a, r.b): r.minutes for r in files.travel_csv(spark, str(tmp_path / "t.csv")).collect()} == {("a", "b"): 4.0, ("b", "a"): 5.0}
    (tmp_path / "p.csv").write_text("from,to,time_s\na,a,60\na,b,90\n,b,60\n")
    assert [tuple(r) for r in files.pair_times_csv(spark, str(tmp_path / "p.csv")).collect()] == [("a", "b", 1.5)]
    (tmp_path / "b.csv").write_text("building,name,lat,lon\n 1 , One ,37.1,x\n")
    assert [tuple(r) for r in files.buildings_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", "One", 37.1, None)]


def test_tracks_keep_fullest_copy(spark, tmp_path):
    head = "walk,walker,device,start,t,lat,lon,alt,acc,speed\n"
    row = lambda w, d, t: f"{w},A,{d},2026-01-01 00:00:00,{t},37.0,127.0,10,5,1\n"
    (tmp_path / "x.csv").write_text(head + row("w1", "p", 0) + row("w1", "p", 1000))
    (tmp_path / "y.csv").write_text(head + row("w1", "p", 0) + row("w1", "p", 1000) + row("w1", "p", 2000) + row("w2", "q", 0))
    out = files.tracks_csv(spark, str(tmp_path)).collect()
    assert sum(r.walk == "w1" for r in out) == 3 and {r.walker for r in out} == {"A-1", "A-2"}


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [127.0, 37.0]}, "properties": {"k": "v"}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = files.geojson(spark, str(tmp_path / "g.json"))
    assert [(r.lon, r.lat, r.properties["k"]) for r in files.geojson_points(g).collect()] == [(127.0, 37.0, "v")]
    assert [(p.lon, p.lat) for p in files.geojson_lines(g).first().line] == [(1.0, 2.0), (3.0, 4.0)]


def test_twins_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", 37.0, 127.0), ("b", None, None)], "id string, lat double, lon double")
    sinks.write_twins(rows, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o/csv")).count() == 2
    features = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "o/geojson")).collect()]
    assert [f["properties"]["id"] for f in features] == ["a"]


def test_section_meta(spark, tmp_path):
    head = ["교과목번호", "강좌번호", "학년", "개설대학", "개설학과", "수강신청인원(현재)", "비고"]
    _workbook(tmp_path / "m.xlsx", [["표"], head, ["C1", "1", "3학년", "공과대학", "nan", "1,234명", "® 공대"], ["C1", "001", "2학년", "공과대학", "기계공학부", "", ""], ["", "1"], ["C2", "L1", "", "", "", "7"]])
    got = {(r.course, r.section): (r.year, r.college, r.dept, r.enrolled, r.remark) for r in xlsx.section_meta(xlsx.read_xlsx(spark, str(tmp_path))).collect()}
    assert got == {("C1", "001"): ("2학년", "공과대학", "기계공학부", 0, ""), ("C2", "L1"): ("", "", "", 7, "")}
    _workbook(tmp_path / "m.xlsx", [head[:4], ["C1", "1", "", "공과대학"]])
    assert [(r.dept, r.enrolled) for r in xlsx.section_meta(xlsx.read_xlsx(spark, str(tmp_path))).collect()] == [("공과대학", 0)]


def test_tracks_need_their_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("walk,walker,device,start,t,lat,lon,alt,accuracy,speed\n1,a,d,2026-01-01T00:00:00Z,0,1,2,3,4,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.tracks_csv(spark, str(tmp_path)).collect()


def test_raster_windows_and_finest_layer(spark):
    layers = spark.createDataFrame([("fine", 0.0, 0.0, 1.0), ("coarse", -5.0, -5.0, 10.0), ("far", 900.0, 900.0, 1.0)], "layer string, x0 double, y0 double, size double")
    fine = [("fine", c, r, float("nan") if (c, r) == (2, 2) else -9999.0 if (c, r) == (0, 0) else c + 10.0 * r) for c in range(6) for r in range(6)]
    coarse = [("coarse", c, r, 100.0 * c + r) for c in range(4) for r in range(4)]
    cells = spark.createDataFrame([*fine, *coarse, ("far", 0, 0, 1.0)], "layer string, col long, row long, z double")
    kept = raster.raster_window(cells, layers, (1.0, 1.0, 3.0, 3.0), margin=1)
    rows = {(r.layer, r.col, r.row): r.z for r in kept.collect()}
    assert {k for k in rows if k[0] == "fine"} == {("fine", c, r) for c in range(5) for r in range(5)} and rows["fine", 2, 2] is None and rows["fine", 0, 0] is None and not any(k[0] == "far" for k in rows)
    points = spark.createDataFrame([(1, 3.5, 3.5), (2, 1.5, 1.5), (3, 20.0, 20.0), (4, 500.0, 1.0)], "point long, x double, y double")
    got = {r.point: (r.layer, r.z) for r in raster.finest_heights(points, cells.where("z > -100 AND NOT isnan(z)"), layers).collect()}
    assert got == {1: ("fine", 38.5), 2: ("coarse", pytest.approx(65.65)), 3: ("coarse", 252.5), 4: (None, None)}


def test_stored_answers(spark):
    rows = [("a|b", "2026-09-01 10:00:00", 200, "x1"), ("a|b", "2026-09-02 10:00:00", 200, "x2"), ("b|c", "2026-09-02 11:00:00", 500, "x"), ("a|c", "2026-09-02 12:00:00", 200, '{"remark": "runtime error: timeout"}'), ("c|d", "2026-08-01 00:00:00", 200, "y")]
    answers = spark.createDataFrame(rows, "key string, asked_at string, status int, body string").withColumn("asked_at", F.col("asked_at").cast("timestamp"))
    assert {(r.key, r.body) for r in stored.newest_answers(answers).collect()} == {("a|b", "x2"), ("c|d", "y")}
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    todo = stored.pairs_to_ask(ids, answers, symmetric=True)
    assert {r.key for r in todo.collect()} == {"a|c", "a|d", "b|c", "b|d"}
    assert len({r.key for r in stored.pairs_to_ask(ids, answers, symmetric=False).collect()}) == 10
    assert [r.key for r in stored.within_quota(todo, answers, "2026-09-02", 5, ["a", "b"]).orderBy("key").collect()] == ["a|c", "a|d"]
    assert {r.key for r in stored.still_to_ask(spark.createDataFrame([("a|b",), ("c|d",)], "key string"), answers, "2026-09-01").collect()} == {"c|d"}
    waits = spark.range(5).select(stored.next_server(["s", "t"], F.col("id")).alias("n")).select("n.*").collect()
    assert [(r.server, r.wait_s) for r in waits] == [("s", 0.0), ("t", 5.0), ("s", 10.0), ("t", 10.0), ("s", 20.0)]


def test_files_by_name_and_signature(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(bytes.fromhex("D0CF11E0A1B1"))
    (tmp_path / "b.xls").write_bytes(b"<html>no</html>")
    (tmp_path / "c.xls").write_bytes(b"")
    assert {(r.path[-5], bool(r.ok)) for r in stored.workbooks(spark, str(tmp_path)).collect()} == {("a", True), ("b", False)}
    names = spark.createDataFrame([("(B060)_37612018_F0010000.shp",), ("n3a_b0010000_376120181.shp",), ("F0020000.shp",), ("readme.txt",)], "n string")
    got = [tuple(r.m) for r in names.select(stored.map_file(F.col("n")).alias("m")).collect()]
    assert got == [("contour", "37612018", 5000), ("building", "376120181", 1000), ("spot", None, None), (None, None, None)]
    page = spark.createDataFrame([('<link href="style.css?v=00ff"><script src="js/app.js"></script> app.js', "<table><tr><th>Kind</th><td> a <b>x</b>&nbsp;y</td></tr><TR><td>2026-01-02 ~\n 2026-01-05</td></TR></table>")], "p string, t string")
    r = page.select(stored.stamped(F.col("p"), F.lit("abc1"), ["style.css", "app.js"]).alias("p"), stored.html_rows(F.col("t")).alias("t"), stored.assets_version(F.array("p")).alias("v"), stored.assets_version(F.array(F.replace("p", F.lit("?v=00ff"), F.lit("")))).alias("w")).first()
    assert r.p == '<link href="style.css?v=abc1"><script src="js/app.js?v=abc1"></script> app.js' and r.t == [["Kind", "a x y"], ["2026-01-02 ~ 2026-01-05"]] and r.v == r.w and len(r.v) == 8
    lines = stored.markdown_rows(spark.createDataFrame([(2, "b|c", None), (1, "a", 0.5)], "i int, name string, x double"), {"name": "Name", "x": "X"}, ["i"]).orderBy("line").collect()
    assert [x.text for x in lines] == ["| Name | X |", "| --- | --- |", "| a | 0.5 |", "| b\\|c |  |"]
