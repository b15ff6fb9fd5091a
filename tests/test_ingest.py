from __future__ import annotations

import json

import pytest
from helpers import as_set, box
from pyspark.sql import functions as F

from zoneflow.functions.ids import normalise_id
from zoneflow.operators import ingest
from zoneflow.plans.ingest_job import ingest_files
from zoneflow.sources import readers, store

HOURS = [f"h{i}" for i in range(24)]


def write_matrix(path, rows, header=None, sep=","):
    lines = [sep.join(header or ["fromZone", "ToZone", *HOURS])]
    lines += [sep.join([a, b, *[str(cells.get(i, 0)) for i in range(24)]]) for a, b, cells in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_normalise_id(spark):
    texts = ["7", "007", "101.0", " 5 ", "A7", "7a", "", "-3", "1.50", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalise_id(F.col("t")).alias("n"))
    assert [r["n"] for r in rows.collect()] == ["7", "7", "101", "5", "A7", "7a", "", "-3", "1.50", None]


def test_melt_keeps_positive_cells_only(spark, tmp_path):
    path = write_matrix(tmp_path / "w.csv", [("007", "2.0", {0: 1.5, 1: -2, 2: "NaN", 3: "", 23: 4}), ("1", "1", {})])
    long = ingest.wide_to_long(readers.read_od_csv(spark, path), "friday")
    assert as_set(long) == {("7", "2", "friday", 0, 1.5), ("7", "2", "friday", 23, 4.0)}
    assert dict(long.dtypes) == {"from_zone": "string", "to_zone": "string", "day": "string", "hour": "int", "trips": "double"}


def test_header_case_and_order_do_not_matter(spark, tmp_path):
    header = ["FROMZONE", "tozone", *[h.upper() for h in HOURS]]
    path = write_matrix(tmp_path / "w.csv", [("1", "2", {5: 3})], header)
    assert as_set(ingest.wide_to_long(readers.read_od_csv(spark, path), "weekday")) == {("1", "2", "weekday", 5, 3.0)}
    lines = [line.split(",") for line in open(path).read().split()]
    turned = tmp_path / "t.csv"
    turned.write_text("\n".join(",".join(reversed(line)) for line in lines))
    assert as_set(ingest.wide_to_long(readers.read_od_csv(spark, str(turned)), "weekday")) == {("1", "2", "weekday", 5, 3.0)}


def test_missing_columns_fail(spark, tmp_path):
    path = write_matrix(tmp_path / "w.csv", [], ["fromZone", "ToZone", *HOURS[:-1]])
    with pytest.raises(ValueError, match="h23"):
        readers.read_od_csv(spark, path)
    with pytest.raises(ValueError, match="fromzone"):
        ingest.wide_to_long(spark.createDataFrame([(1,)], "a int"), "weekday")


def test_text_in_an_hour_cell_fails(spark, tmp_path):
    path = write_matrix(tmp_path / "w.csv", [("1", "2", {5: "many"})])
    with pytest.raises(Exception):
        ingest.wide_to_long(readers.read_od_csv(spark, path), "weekday").collect()


def level_names(spark, rows, kind="string"):
    return ingest.clean_level_names(spark.createDataFrame(rows, f"id {kind}, NAME string, src_order int"))


def test_float_ids_become_whole_only_if_all_are_numbers(spark):
    assert as_set(level_names(spark, [("300001.0", "a", 1), ("7.9", "b", 2)])) == {("300001", "a"), ("7", "b")}
    assert as_set(level_names(spark, [("300001.5", "a", 1), ("N", "b", 2)])) == {("300001.5", "a"), ("N", "b")}


def test_first_name_wins_and_null_ids_go(spark):
    rows = [(3.0, "late", 9), (3.0, "first", 1), (None, "sub-header", 0), (4.0, None, 2), (4.0, "x", 3)]
    assert as_set(level_names(spark, rows, "double")) == {("3", "first"), ("4", None)}


def test_sheets(spark, tmp_path):
    sheet = tmp_path / "33.csv"
    sheet.write_text(" TAZ_33 ,NAME\n,sub\n1.0,North\n1.0,Again\n")
    assert as_set(ingest.clean_level_names(readers.read_level_names(spark, str(sheet)))) == {("1", "North")}
    sheet.write_text("TAZ_33,title\n1,North\n")
    assert readers.read_level_names(spark, str(sheet)) is None
    assert readers.read_level_names(spark, None) is None
    names = tmp_path / "names.csv"
    names.write_text("TAZ_1270,b,c,d,e,f,zone_name\nid,,,,,,name\n001,,,,,,One\n1,,,,,,Uno\n2,,,,,,\n")
    assert as_set(ingest.clean_zone_names(readers.read_zone_names(spark, str(names)))) == {("id", "name"), ("1", "One"), ("2", None)}
    names.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_zone_names(spark, str(names))


def feature(taz, g33, city, coordinates, kind="Polygon"):
    properties = {"TAZ_1270": taz, "TAZ_250": g33, "TAZ_33": g33, "TAZ_15": 1, "CITY": city}
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.fixture
def raw(tmp_path):
    features = [
        feature(1, 10, " Haifa ", [box(0, 0)]), feature(2, 10, "Haifa", [box(1, 0)]),
        feature(3, 20, "Lod", [[box(5, 5)], [box(7, 7)]], "MultiPolygon"), feature(4, 20, None, [box(9, 9)]),
    ]
    (tmp_path / "zones.jsonl").write_text("\n".join(map(json.dumps, features)))
    (tmp_path / "zones.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "names.csv").write_text("TAZ_1270,b,c,d,e,f,zone_name\nsub,,,,,,\n1,,,,,,One\n2,,,,,,Two\n")
    (tmp_path / "33.csv").write_text("ID,NAME\n10.0,North\n")
    matrices = {
        day: write_matrix(tmp_path / f"{day}.csv", [("1", "3", {8: value}), ("1", "2", {8: 1}), ("1", "99", {9: 2})])
        for day, value in (("weekday", 10), ("friday", 5), ("saturday", 2))
    }
    return tmp_path, matrices


@pytest.mark.parametrize("layout", ["lines", "collection"])
def test_whole_ingestion(spark, raw, layout):
    folder, matrices = raw
    out = str(folder / f"out-{layout}")
    source = str(folder / ("zones.jsonl" if layout == "lines" else "zones.json"))
    report = ingest_files(spark, matrices, source, str(folder / "names.csv"), out, {"g33": str(folder / "33.csv")}, layout=layout)
    assert report.first().asDict() == {
        "n_rows": 9, "n_days": 3, "days": "friday,saturday,weekday", "min_trips": 1.0, "max_trips": 10.0,
        "n_od_zones": 4, "n_zones": 4, "n_missing": 1, "n_unnamed": 2,
    }
    base = {r["taz"]: r for r in store.read_zones(spark, out).collect()}
    assert base["1"]["city"] == "Haifa" and base["1"]["zone_name"] == "One" and base["3"]["zone_name"] is None
    assert base["1"]["name_33"] == "North" and base["3"]["name_33"] is None and base["3"]["name_250"] == "20"
    assert (base["3"]["centroid_lon"], base["3"]["centroid_lat"]) == (6.5, 6.5)
    groups = {r["group_id"]: r for r in store.read_zones(spark, out, "g33").collect()}
    assert groups["10"]["geometry"] == [[[[0, 0], [1, 0], [2, 0], [2, 1], [1, 1], [0, 1], [0, 0]]]]
    assert groups["10"]["label"] == "North" and groups["10"]["centroid_lon"] == 1.0
    assert len(groups["20"]["geometry"]) == 3
    assert {r["group_id"] for r in store.read_zones(spark, out, "city").collect()} == {"Haifa", "Lod"}
    assert spark.sql("SELECT SUM(trips) FROM od_matrix WHERE day = 'friday'").first()[0] == 8.0


def test_repeated_zone_fails(spark, raw):
    folder, matrices = raw
    twice = (folder / "zones.jsonl").read_text() + "\n" + json.dumps(feature("01", 10, "Haifa", [box(0, 3)]))
    (folder / "twice.jsonl").write_text(twice)
    with pytest.raises(ValueError, match="more than once"):
        ingest_files(spark, matrices, str(folder / "twice.jsonl"), str(folder / "names.csv"), str(folder / "bad"))


def test_all_day_types_are_needed(spark):
    with pytest.raises(ValueError):
        ingest_files(spark, {"weekday": "x"}, "a", "b", "c")


def test_boundary_columns(spark):
    with pytest.raises(ValueError, match="TAZ_250"):
        ingest.clean_boundaries(spark.createDataFrame([("1",)], "TAZ_1270 string"))
