from __future__ import annotations

import pytest
from helpers import as_set, flow_table, model, od_table, zone
from pyspark.sql import functions as F

from zoneflow import flow_set, texts
from zoneflow.operators import export, flowmap, quality
from zoneflow.plans.modes import Selection
from zoneflow.sources import sinks


@pytest.fixture(scope="module")
def zones(spark):
    return model(spark, [zone("1", "A", "X", "Alpha"), zone("2", "B", "X"), zone("3", "C", "Y", "Gamma")])


def lists(spark, names, max_chars=120):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(names)], "group_id string, ord int, name string")
    return export.name_lists(rows, max_chars).first()["names"]


def by_hand(names, budget):
    """The rule, one name at a time."""
    whole = ", ".join(names)
    if len(whole) <= budget:
        return whole
    more = "ועוד {} אזורים".format
    best = None
    for k in range(1, len(names) + 1):
        left = len(names) - k
        text = ", ".join(names[:k] + ([more(left)] if left else []))
        if len(text) > budget:
            break
        best = text
    return best or more(len(names))


@pytest.mark.parametrize("names, budget", [
    (["one"], 120), (["aa", "bb", "cc"], 10), (["aa", "bb", "cc"], 9), (["x" * 200, "y"], 120), (["n" * 30] * 8, 120),
    (["a"] * 500, 120), ([""] * 300, 40), (["short", "l" * 90, "s"], 60), ([f"zone {i}" for i in range(40)], 120), (["ab"] * 6, 21),
])
def test_name_list_keeps_the_longest_prefix_that_fits(spark, names, budget):
    assert lists(spark, names, budget) == by_hand(names, budget)


def test_selected_zone_list(zones):
    assert export.selected_zone_list(zones, "taz", ["3", "2", "9", "1"]).first()["names"] == "Gamma, 2, 9, Alpha"


def test_search(zones):
    def find(text, selected=()):
        return [r["id"] for r in export.search_zones(zones, "taz", text, selected).collect()]

    assert find("MM") == ["3"] and find("a") == [] and find("alpha", ["1"]) == [] and find("%%") == []
    assert [r["id"] for r in export.search_zones(zones, "g33", "me").collect()] == ["A", "B", "C"]


def test_search_limit_and_order(spark):
    many = model(spark, [zone(f"z{i:02d}") for i in range(30)])
    assert [r["id"] for r in export.search_zones(many, "taz", "z").collect()] == []
    assert [r["id"] for r in export.search_zones(many, "taz", "z1").collect()] == [f"z1{i}" for i in range(8)]


FLOWS = [("outgoing", "1", "3", 2.5), ("incoming", "3", "1", 2.6), ("internal", "1", "1", 9.4), ("internal", "1", "2", 9.0)]


def test_flow_table_types_and_order(spark, zones):
    selection = Selection(ids=["1", "2"], map_level="taz", mode=4)
    rows = export.sorted_flow_table(export.flow_table(flow_table(spark, FLOWS), zones, selection)).collect()
    assert [(r["origin_name"], r["dest_name"], r["trips"], r["type"]) for r in rows] == [
        ("Alpha", "Alpha", 9, "פנים אזורי"), ("Alpha", "2", 9, "בין אזורים נבחרים"), ("Alpha", "Gamma", 3, "יוצא"), ("Gamma", "Alpha", 3, "נכנס")]


def test_labels_come_from_the_level_of_each_side(spark):
    """Ids may repeat across levels."""
    zones = model(spark, [zone("A", "1", name="base A"), zone("1", "A", name="base 1")])
    flows = flow_table(spark, [("outgoing", "1", "1", 1.0), ("incoming", "1", "1", 1.0)])
    rows = flowmap.label_flows(flows, zones, "taz", "g33").select("tag", "origin_label", "dest_label")
    assert as_set(rows) == {("outgoing", "base 1", "name 1"), ("incoming", "name 1", "base 1")}


def test_summary(spark, zones):
    od = od_table(spark, [("1", "2", "friday", 8, 2.4), ("2", "1", "friday", 8, 1.4), ("1", "3", "friday", 8, 1.0)])
    selection = Selection(ids=["2", "1"], map_level="TAZ_1270", mode=2, day="friday", hour_min=7, hour_max=10, min_trips=1.5, cap=5)
    flagged = flow_set(od, zones, selection, with_flag=True)
    rows = [(r["key"], r["value"]) for r in export.summary_table(flagged, zones, selection).orderBy("ord").collect()]
    assert rows == [
        (texts.KEY_DAY, "יום שישי"), (texts.KEY_HOURS, "7–10"), (texts.KEY_MIN_TRIPS, "1.5"), (texts.KEY_SELF_LOOPS, "לא"),
        (texts.KEY_LEVEL, "TAZ_1270"), (texts.KEY_FLOWS, "1"), (texts.KEY_TRIPS, "2"), (texts.KEY_ZONES, "2"), ("", "Alpha")]
    assert export.export_name(selection) == "od_flows_TAZ_1270_friday_7-10"
    assert export.legend_line(selection) == "friday · h7–h10 (excl.) · min 1.5 trips"
    assert spark.range(1).select(export.filter_line(selection)).first()[0] == "יום שישי · ‪7–10‬"


def test_flows_without_centroid_drop_out_but_count_for_the_width(spark, zones):
    rows = flowmap.flow_geometry(flow_table(spark, [("internal", "1", "2", 1.0), ("internal", "1", "None", 4.0)]), zones, "taz")
    assert [r["width"] for r in rows.collect()] == [2 + 12 / 8]


def test_features_and_relevant_zones(spark, zones):
    flows = flow_table(spark, FLOWS[:1])
    line = flowmap.line_features(flowmap.flow_geometry(flows, zones, "taz")).first()["feature"]
    assert line.startswith('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0.5,0.5],[0.5,0.5]]},"properties":{"origin_id":"1"')
    arrow = flowmap.arrow_features(flowmap.flow_geometry(flows, zones, "taz")).first()["feature"]
    assert '"type":"Point","coordinates":[0.5,0.5]' in arrow
    relevant = flowmap.relevant_zones(flows, zones, ["2"], "taz")
    assert {(r["id"], r["label"]) for r in relevant.collect()} == {("1", "Alpha"), ("2", "2"), ("3", "Gamma")}
    assert flowmap.label_points(relevant).count() == 3
    caption = flowmap.captions(flowmap.label_flows(flow_table(spark, [("outgoing", "1", "3", 12345.5)]), zones, "taz")).first()["caption"]
    assert caption == "Alpha ← Gamma, 12,346 נסיעות"


def test_quality(spark, zones):
    od = od_table(spark, [("1", "9"), ("8", "9"), ("1", "2", "friday", 3, 7.0)])
    assert quality.quality_summary(od, zones).first().asDict() == {
        "n_rows": 3, "n_days": 2, "days": "friday,weekday", "min_trips": 1.0, "max_trips": 7.0, "n_od_zones": 4, "n_zones": 3,
        "n_missing": 2, "n_unnamed": 1}
    assert [r[0] for r in quality.first_unmatched(od, zones).collect()] == ["8", "9"]
    meta = quality.od_metadata(od).first()
    assert (meta["trips_min"], meta["trips_lowest"], meta["trips_max"], meta["hour_max"]) == (1.0, 1.0, 7.0, 23)
    twice = zones.base.unionByName(zones.base.where("taz = '1'"))
    assert as_set(quality.duplicate_zones(twice)) == {("1", 2)}


def test_sinks(spark, zones, tmp_path):
    selection = Selection(ids=["1", "2"], map_level="taz", mode=4, include_self_loops=True)
    flows = flow_table(spark, FLOWS)
    flagged = flows.withColumn("truncated", F.lit(False))
    table = export.flow_table(flows, zones, selection).drop("tag")
    sinks.write_flow_export(table, export.summary_table(flagged, zones, selection), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x/flows")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "x/summary")).columns == ["key", "value"]
    sinks.write_flows(flows, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 4
    sinks.write_features(flowmap.line_features(flowmap.flow_geometry(flows, zones, "taz")), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).where("geometry.type = 'LineString'").count() == 4
    from zoneflow.operators import breakdown

    rows = breakdown.export_table(breakdown.slices(flows, zones, breakdown.tabs_of(4), True, "taz"))
    sinks.write_breakdown_export(rows, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).where("tab = 'overview'").count() == 5
