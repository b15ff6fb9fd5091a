"""Shapefiles, workbooks and documents in several files: written, read back, and refused when broken."""

from __future__ import annotations

import json
import struct
import zipfile
from pathlib import Path

import pytest
from helpers import box, ring
from pyspark.sql import functions as F

from zoneflow.functions.geometry import GEOMETRY_TYPE
from zoneflow.operators import ingest
from zoneflow.plans.ingest_job import load_zones
from zoneflow.sources import readers, sinks

SHAPES = f"TAZ_1270 string, CITY string, geometry {GEOMETRY_TYPE}"


def normal(shape):
    """Polygons as sets of rings whose first vertex is the smallest, whatever their direction."""
    def turned(loop):
        points = [tuple(p) for p in loop[:-1]]
        at = points.index(min(points))
        points = points[at:] + points[:at]
        return min(tuple(points), (points[0], *points[:0:-1]))

    return sorted((turned(p[0]), tuple(sorted(turned(h) for h in p[1:]))) for p in shape or [])


def shape_rows(n):
    donut = [box(0, 0, 4, 4), list(reversed(box(1, 1))), box(2.5, 2.5)]
    rows = [("1", "חיפה", [donut, [box(10, 10)]]), ("2", None, [[ring((0, 0), (3, 1), (1, 3))]]), ("3", "x", None)]
    return rows + [(str(i), f"city {i % 7}", [[box(i, i % 5, 0.5, 0.25)]]) for i in range(4, n)]


def test_shapefile_round_trip_in_splits(spark, tmp_path):
    rows = shape_rows(500)
    sinks.write_shapefile(spark.createDataFrame(rows, SHAPES).repartition(3, "TAZ_1270"), str(tmp_path / "zones"))
    assert len(list((tmp_path / "zones").glob("*.shp"))) == 3 and not list((tmp_path / "zones").glob("_*"))
    for records in (20_000, 7):
        found = spark.read.format("shapefile").option("splitRecords", records).load(str(tmp_path / "zones"))
        assert found.columns == ["TAZ_1270", "CITY", "geometry"]
        assert found.rdd.getNumPartitions() == (3 if records > 500 else sum(-(-n // 7) for n in counts(tmp_path / "zones")))
        got = {r.TAZ_1270: (r.CITY, r.geometry and normal(r.geometry)) for r in found.collect()}
        assert got == {a: (b, g and normal(g)) for a, b, g in rows}


def counts(folder):
    return [(p.stat().st_size - 100) // 8 for p in Path(folder).glob("*.shx")]


def test_shapefile_in_another_encoding(spark, tmp_path):
    sinks.write_shapefile(spark.createDataFrame(shape_rows(4), SHAPES).coalesce(1), str(tmp_path / "z"), "iso-8859-8")
    assert {r.CITY for r in readers.read_shapefile(spark, str(tmp_path / "z"), "cp1255").collect()} == {"חיפה", None, "x"}


def test_broken_shapefiles_are_refused(spark, tmp_path):
    sinks.write_shapefile(spark.createDataFrame(shape_rows(9), SHAPES).coalesce(1), str(tmp_path / "z"))
    (shp,) = (tmp_path / "z").glob("*.shp")
    whole = shp.read_bytes()

    def fails(data, match):
        shp.write_bytes(data)
        with pytest.raises(Exception, match=match):
            spark.read.format("shapefile").load(str(tmp_path / "z")).collect()

    fails(whole[:-20], "ends early")
    fails(whole[:108] + struct.pack("<i", 3) + whole[112:], "no polygon")
    fails(whole[:104] + struct.pack(">i", 7) + whole[108:], "index")
    at = 108 + 44 + 4 * 4  # first coordinate of the first ring
    fails(whole[:at] + struct.pack("<d", 77.0) + whole[at + 8 :], "not closed")
    shp.with_suffix(".dbf").unlink()
    fails(whole, "dbf|No such file|open")


def test_deleted_rows_are_left_out(spark, tmp_path):
    sinks.write_shapefile(spark.createDataFrame(shape_rows(6), SHAPES).coalesce(1), str(tmp_path / "z"))
    (dbf,) = (tmp_path / "z").glob("*.dbf")
    data = bytearray(dbf.read_bytes())
    start, width = struct.unpack_from("<HH", data, 8)
    data[start + width] = ord("*")
    dbf.write_bytes(data)
    assert {r.TAZ_1270 for r in readers.read_shapefile(spark, str(tmp_path / "z")).collect()} == {"1", "3", "4", "5"}


def spreadsheet(path, sheets):
    """A workbook as office programs write it: shared strings, number cells and gaps."""
    strings, parts = [], {}
    for i, rows in enumerate(sheets.values(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, value in enumerate(row):
                at = f"{chr(65 + c)}{r}"
                if isinstance(value, str):
                    strings.append(value)
                    cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
                elif value is not None:
                    cells += f'<c r="{at}"><v>{value}</v></c>'
            lines.append(f'<row r="{r}">{cells}</row>')
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
    related = "".join(f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>'
    items = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{items}</sst>'
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def test_names_of_one_workbook(spark, tmp_path):
    path = str(tmp_path / "names.xlsx")
    head = ["TAZ_1270", "TAZ_250", "TAZ_33", "TAZ_15", "e", "f", "name"]
    names = [head, ["sub", None, None, None, None, None, "header"], [7, 1, 1, 1, None, None, "seven &lt; eight"], [8, 1, 1, 1, "", "", None], [7, 1, 1, 1, "", "", "again"]]
    spreadsheet(path, {"zones": names, "33": [["NAME", "TAZ_33 id"], ["first", 1.0], ["twice", 1.0], ["none", None]], "15": [["x"], ["y"]]})
    assert {(r.taz, r.zone_name) for r in ingest.clean_zone_names(readers.read_zone_names(spark, path)).collect()} >= {("7", "seven < eight"), ("8", None)}
    rows = ingest.clean_level_names(readers.read_level_names(spark, path, sheet="33")).collect()
    assert [tuple(r) for r in rows] == [("1", "first")]
    assert readers.read_level_names(spark, path, sheet="250") is None and readers.read_level_names(spark, path, sheet="15") is None

    zones = spark.createDataFrame([("7", "1", "1", "1", "C", [[box(0, 0)]]), ("8", "1", "1", "1", "C", [[box(1, 0)]])], f"TAZ_1270 string, TAZ_250 string, TAZ_33 string, TAZ_15 string, CITY string, geometry {GEOMETRY_TYPE}")
    sinks.write_shapefile(zones, str(tmp_path / "zones"))
    found = {r.taz: r for r in load_zones(spark, str(tmp_path / "zones"), path, layout="shapefile").collect()}
    assert (found["7"].zone_name, found["7"].name_33, found["7"].name_250, found["8"].zone_name) == ("seven < eight", "first", "1", None)
    assert (found["8"].centroid_lon, found["8"].centroid_lat) == (1.5, 0.5)


def test_workbook_round_trip(spark, tmp_path):
    rows = [(i, f"name <{i}> & more" if i % 3 else None, i / 4) for i in range(40)]
    sinks.write_workbook(spark.createDataFrame(rows, "id bigint, name string, share double").coalesce(1), str(tmp_path / "book"), "flows")
    (path,) = (tmp_path / "book").glob("*.xlsx")
    found = readers.read_workbook(spark, str(path), "flows").orderBy("row").collect()
    assert [r.row for r in found] == list(range(1, 42)) and found[0].cells == ["id", "name", "share"]
    assert [(int(r.cells[0]), r.cells[1], float(r.cells[2])) for r in found[1:]] == rows
    assert readers.read_workbook(spark, str(path), "other").isEmpty()


def test_collection_is_one_document(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files, however small
    features = spark.range(3000).select(F.col("id").alias("idx"), F.concat(F.lit('{"type":"Feature","id":'), "id", F.lit("}")).alias("feature"))
    for n in (3000, 1, 0):
        path = str(tmp_path / f"doc{n}")
        sinks.write_collection(features.where(F.col("idx") < n).repartition(7), path)
        parts = sorted(Path(path).glob("part-*"))
        document = json.loads("".join(p.read_text() for p in parts))
        assert [f["id"] for f in document["features"]] == list(range(n)) and document["type"] == "FeatureCollection"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sorted((tmp_path / "doc3000").glob("part-*"))) > 1


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    names = ["fromZone", "ToZone", *[f"h{i}" for i in range(24)]]
    for i in range(40):
        order = names if i % 2 else names[::-1]
        values = {"fromZone": f"a{i}", "ToZone": "b"} | {f"h{k}": str(i + k) for k in range(24)}
        (tmp_path / f"f{i}.csv").write_text(",".join(order) + "\n" + ",".join(values[n] for n in order) + "\n")
    (tmp_path / "empty.csv").write_text("")
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup(None))
    wide = readers.read_od_csv(spark, str(tmp_path))
    assert len(status.getJobIdsForGroup(None)) - before <= 4
    got = {r.fromzone: r.h3 for r in wide.select("fromzone", "h3").collect()}
    assert got == {f"a{i}": i + 3.0 for i in range(40)}
