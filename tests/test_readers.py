"""Files that a reader must read right or refuse."""

from __future__ import annotations

import json

import pytest

from zoneflow.operators import ingest
from zoneflow.params import LEVEL_SOURCE
from zoneflow.sources import readers

HOURS = [f"h{h}" for h in range(24)]


def write_matrix(path, columns, values):
    path.write_text(",".join(columns) + "\n" + ",".join(values.get(c, "0") for c in columns) + "\n", encoding="utf-8")


def test_files_of_one_folder_may_order_columns_differently(spark, tmp_path):
    names = ["fromZone", "ToZone", *HOURS]
    write_matrix(tmp_path / "a.csv", names, {"fromZone": "5", "ToZone": "6", "h23": "23"})
    write_matrix(tmp_path / "b.csv", names[::-1], {"fromZone": "5", "ToZone": "6", "h0": "7"})
    write_matrix(tmp_path / "c.csv", ["TOZONE", "extra", "fromzone", *HOURS], {"TOZONE": "8", "fromzone": "5", "h1": "2", "extra": "x"})
    rows = ingest.wide_to_long(readers.read_od_csv(spark, str(tmp_path)), "weekday").collect()
    assert {(r.from_zone, r.to_zone, r.hour, r.trips) for r in rows} == {("5", "6", 23, 23.0), ("5", "6", 0, 7.0), ("5", "8", 1, 2.0)}


def feature(geometry):
    return json.dumps({"type": "Feature", "properties": {c: "1" for c in LEVEL_SOURCE.values()}, "geometry": geometry})


@pytest.mark.parametrize("geometry", [
    {"type": "Polygon", "coordinates": [[[0, 0], [1, "x"], [1, 1], [0, 0]]]},
    {"type": "GeometryCollection", "geometries": []},
    {"type": "Point", "coordinates": [1, 2]},
])
def test_boundaries_that_are_no_polygons_fail(spark, tmp_path, geometry):
    good = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    path = tmp_path / "zones.json"
    path.write_text(feature(good) + "\n" + feature(geometry) + "\n")
    with pytest.raises(Exception):
        readers.read_boundaries(spark, str(path)).collect()


def test_encodings(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_bytes("id,b,c,d,e,f,NAME\n1,,,,,,\u05e9\u05dc\u05d5\u05dd\n".encode("cp1255"))
    with pytest.raises(ValueError, match="javaCharsets"):
        readers.read_zone_names(spark, str(path), "cp1255")
    spark.conf.set(readers.LEGACY_CHARSETS, "true")
    try:
        assert [r.zone_name for r in readers.read_zone_names(spark, str(path), "cp1255").collect()] == ["\u05e9\u05dc\u05d5\u05dd"]
        shapes = tmp_path / "zones.json"
        shapes.write_bytes(feature({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}).replace('"1"', '"\u05e9"').encode("iso-8859-8"))
        rows = readers.read_boundaries(spark, str(shapes), encoding="iso-8859-8").collect()
        assert rows[0]["CITY"] == "\u05e9" and len(rows[0].geometry) == 1
    finally:
        spark.conf.unset(readers.LEGACY_CHARSETS)
