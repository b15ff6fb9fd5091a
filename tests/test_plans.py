"""What the optimizer makes of the queries."""

from __future__ import annotations

import pytest
from helpers import as_set
from pyspark.sql import functions as F

from zoneflow import FlowQuery, ZoneModel, flow_rollup, flow_set
from zoneflow.operators import breakdown
from zoneflow.operators.rollup import all_flows
from zoneflow.plans import retail_tables as retail
from zoneflow.plans.modes import Selection


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir)


def test_rollup_is_one_scan_and_one_shuffle(tables):
    text = plan(flow_rollup(*tables, FlowQuery(level="g33", day="weekday", hour_min=7, hour_max=10)))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "TakeOrderedAndProject" not in text
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "isnotnull(day" in filters and "= weekday)" in filters and ">= 7)" in filters and "< 10)" in filters
    assert "ReadSchema: struct<from_zone:string,to_zone:string,trips:double>" in text
    assert "geometry" not in text


def test_hours_are_folders_of_the_stored_table(tables):
    od, zones = tables
    read = flow_rollup(od, zones, FlowQuery(level="g33", day="weekday", hour_min=7, hour_max=10))
    assert read.count() > 0
    folders = {f.rsplit("/", 2)[-2] for f in od.inputFiles()}
    assert folders == {f"hour={h}" for h in range(24)}


def test_cross_level_uses_an_anti_join_after_the_rollup(tables):
    text = plan(flow_rollup(*tables, FlowQuery(origin_level="g33", dest_level="city")))
    assert "LeftAnti" in text
    assert text.index("LeftAnti") < text.index("HashAggregate(keys=[origin_id")
    kept = plan(flow_rollup(*tables, FlowQuery(origin_level="g33", dest_level="city", include_self_loops=True)))
    assert "LeftAnti" not in kept


def test_id_predicates_reach_the_zone_scan(tables):
    text = plan(flow_rollup(*tables, FlowQuery(level="g33", origin_ids=["3", "7"])))
    assert "coalesce(g33" in text and text.index("Filter (coalesce") > text.index("BroadcastHashJoin")
    # plans print from the last join down to the scans, so the filtered side, joined first, comes second
    for ids in ({"origin_ids": ["3"]}, {"dest_ids": ["3"]}):
        text = plan(flow_rollup(*tables, FlowQuery(level="g33", **ids)))
        first_join = text.rindex("BroadcastHashJoin [xxhash64(")
        column = "from_zone" if "origin_ids" in ids else "to_zone"
        assert text[first_join:].startswith(f"BroadcastHashJoin [xxhash64({column}")


def test_large_zone_tables_are_not_broadcast(spark, tables):
    od, zones = tables
    wide = ZoneModel(zones.base, broadcast_rows=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(all_flows(od, wide, FlowQuery(level="g33")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 2
    assert "partial_sum" in text and text.count("keys=[origin_id") >= 2


def test_a_selection_in_a_large_zone_table_is_broadcast(spark, tables):
    od, zones = tables
    wide = ZoneModel(zones.base, broadcast_rows=200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for ids in ({"origin_ids": ["3"]}, {"dest_ids": ["3"]}):
            q = FlowQuery(origin_level="g33", dest_level="g250", cap=None, **ids)
            df = all_flows(od, wide, q)
            text = plan(df)
            assert text.count("BroadcastHashJoin [xxhash64(") == 1 and "SortMergeJoin" in text
            assert text.rindex("BroadcastHashJoin") > text.index("SortMergeJoin")  # before the trips move
            assert as_set(df) == as_set(all_flows(od, zones, q))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_combined_mode_scans_the_trips_once(tables):
    text = plan(flow_set(*tables, Selection(ids=["3", "7", "11"], map_level="g33", mode=4, cap=20)))
    assert text.count("ReadSchema: struct<from_zone:string") == 1
    assert "WindowGroupLimit" in text


def test_breakdown_reads_the_flows_once(tables):
    od, zones = tables
    flows = flow_set(od, zones, Selection(ids=["3", "7", "11"], map_level="g33", mode=4))
    text = plan(breakdown.export_table(breakdown.slices(flows, zones, breakdown.tabs_of(4), True, "g33")))
    assert text.count("ReadSchema: struct<from_zone:string") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hot_zone_in_the_shuffle_plan(spark, tables):
    """A third of all trips start in one zone; the shuffle join splits that partition and the result stays the same."""
    od, zones = tables
    hot = od.withColumn("from_zone", F.when(F.col("hour") % 3 == 0, "7").otherwise(F.col("from_zone")))
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    q = FlowQuery(level="taz", cap=None)
    want = as_set(all_flows(hot, zones, q))
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        df = all_flows(hot, ZoneModel(zones.base, broadcast_rows=0), q, pre_aggregate=False)
        got = as_set(df)
        assert "skew=true" in plan(df)
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == want
