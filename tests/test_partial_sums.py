"""Flows from stored sums between groups."""

from __future__ import annotations

import itertools

import pytest
from helpers import as_set, model, od_table, zone

from zoneflow import FlowQuery, flow_rollup
from zoneflow.operators import partial_sums
from zoneflow.params import LEVELS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    zones = [zone(str(i), f"m{i % 6}", f"city{i % 5}", g250=f"s{i % 12}", g15=f"l{i % 3}") for i in range(36)]
    trips = [(str(i * 7 % 40), str(i * 11 % 38), ("weekday", "friday")[i % 2], i % 24, float(1 + i % 9)) for i in range(900)]
    od, known = od_table(spark, trips), model(spark, zones)
    sums = partial_sums.write_sums(od, known, str(tmp_path_factory.mktemp("sums")), [("g33", "g33"), ("g250", "g250"), ("g15", "city")])
    return od, known, sums


def test_levels_that_nest_are_found(tables):
    _, zones, _ = tables
    assert {(a, b) for a, b in partial_sums.refinements(zones) if a != b} == {
        *(("taz", b) for b in LEVELS if b != "taz"), ("g250", "g33"), ("g250", "g15"), ("g33", "g15"),
    }


def test_smallest_covering_sums(spark, tables):
    _, zones, sums = tables
    assert sums.covering("g15", "g15") == ("g33", "g33") and sums.covering("g250", "g33") == ("g250", "g250")
    assert sums.covering("g15", "city") == ("g15", "city") and sums.covering("taz", "g33") is None and sums.covering("city", "g33") is None
    assert sums.rows["g33", "g33"] < sums.rows["g250", "g250"] <= 900
    again = partial_sums.read_sums(spark, zones, sums.folder)
    assert again == sums


def test_equal_to_the_rollup_of_trips(tables):
    od, zones, sums = tables
    for origin, dest in itertools.product(LEVELS, LEVELS):
        for more in ({}, {"day": "weekday", "hour_min": 6, "hour_max": 15, "include_self_loops": True, "min_trips": 12}):
            query = FlowQuery(origin_level=origin, dest_level=dest, **more)
            if sums.covering(origin, dest) and (more or origin != "g250"):
                assert as_set(partial_sums.flows_from_sums(od, zones, sums, query)) == as_set(flow_rollup(od, zones, query)), (origin, dest, more)
    picked = FlowQuery(level="g33", origin_ids=["m1", "m4"], exclude_dest_ids=["m2"])
    assert as_set(partial_sums.flows_from_sums(od, zones, sums, picked)) == as_set(flow_rollup(od, zones, picked))
    base = FlowQuery(level="taz", cap=5)
    assert as_set(partial_sums.flows_from_sums(od, zones, sums, base)) == as_set(flow_rollup(od, zones, base))


def test_reads_the_sums_and_not_the_trips(tables):
    od, zones, sums = tables
    text = partial_sums.flows_from_sums(od, zones, sums, FlowQuery(level="g15", day="friday"))._jdf.queryExecution().executedPlan().toString()
    assert "sums/g33-g33" in text and text.count("FileScan parquet") == 1
