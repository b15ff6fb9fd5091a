from __future__ import annotations

import itertools
import random

import pytest
from helpers import as_set, model, od_table, zone
from pyspark.sql import functions as F

from zoneflow import FlowQuery, ZoneModel, flow_rollup
from zoneflow.operators.rollup import all_flows, is_truncated, ranked_flows
from zoneflow.params import LEVELS
from zoneflow.plans import retail_tables as retail


@pytest.fixture(scope="module")
def zones(spark):
    return model(spark, [zone("1", "A", "X"), zone("2", "A", "Y"), zone("3", "B", "Y"), zone("4", None, "Z")])


def flows(od, zones, **params):
    return as_set(flow_rollup(od, zones, FlowQuery(**{"min_trips": 0, **params})))


def test_hours_are_half_open_and_equal_bounds_are_empty(spark, zones):
    od = od_table(spark, [("1", "3", "weekday", h, 1.0) for h in (6, 7, 9, 10)])
    assert flows(od, zones, level="g33", hour_min=7, hour_max=10) == {("A", "B", 2.0)}
    assert flows(od, zones, level="g33", hour_min=7, hour_max=7) == set()


def test_no_day_sums_all_day_types(spark, zones):
    od = od_table(spark, [("1", "3", day, 8, 2.0) for day in ("weekday", "friday", "saturday")])
    assert flows(od, zones, level="g33") == {("A", "B", 6.0)}
    assert flows(od, zones, level="g33", day="friday") == {("A", "B", 2.0)}


def test_min_trips_applies_to_the_sum_and_is_inclusive(spark, zones):
    od = od_table(spark, [("1", "3", "weekday", 8, 0.6), ("2", "3", "weekday", 9, 0.4)])
    assert flows(od, zones, level="g33", min_trips=1) == {("A", "B", 1.0)}
    assert flows(od, zones, level="g33", min_trips=1.01) == set()


def test_self_loops(spark, zones):
    od = od_table(spark, [("1", "2"), ("1", "1")])
    assert flows(od, zones, level="g33") == set()
    assert flows(od, zones, level="g33", include_self_loops=True) == {("A", "A", 2.0)}
    assert flows(od, zones, level="taz") == {("1", "2", 1.0)}


def test_cross_level_drops_pairs_that_share_a_zone_as_a_whole(spark, zones):
    # A and Y share zone 2, so also the trip from 1 to 3 (both outside 2) goes
    od = od_table(spark, [("1", "3"), ("1", "4"), ("3", "1")])
    assert flows(od, zones, origin_level="g33", dest_level="city") == {("A", "Z", 1.0), ("B", "X", 1.0)}
    kept = flows(od, zones, origin_level="g33", dest_level="city", include_self_loops=True)
    assert kept == {("A", "Y", 1.0), ("A", "Z", 1.0), ("B", "X", 1.0)}


def test_missing_parent_is_the_group_none(spark, zones):
    od = od_table(spark, [("1", "4")])
    assert flows(od, zones, level="g33") == {("A", "None", 1.0)}
    assert as_set(zones.labels(["g33"]).select("id")) == {("A",), ("B",)}


def test_unknown_zones_drop_out(spark, zones):
    od = od_table(spark, [("1", "9"), ("9", "1"), ("1", "3"), ("1", None), (None, "3")])
    assert flows(od, zones, level="g33") == {("A", "B", 1.0)}


def test_id_predicates_combine(spark, zones):
    od = od_table(spark, [("1", "3"), ("3", "1"), ("1", "4"), ("3", "4")])
    assert flows(od, zones, level="g33", origin_ids=["A", "B"], exclude_dest_ids=["None"]) == {("A", "B", 1.0), ("B", "A", 1.0)}
    assert flows(od, zones, level="g33", origin_ids=["A"], exclude_origin_ids=["A"]) == set()
    assert flows(od, zones, level="g33", origin_ids=["it's"]) == set()


def test_cap_ties_and_truncation(spark, zones):
    od = od_table(spark, [("1", "3", "weekday", 8, 5.0), ("2", "3", "weekday", 8, 5.0), ("3", "1", "weekday", 8, 7.0)])
    q = FlowQuery(level="taz", cap=2)
    got = [tuple(r) for r in ranked_flows(od, zones, q).orderBy("rnk").collect()]
    assert got == [("3", "1", 7.0, 1, True), ("1", "3", 5.0, 2, True)]
    assert is_truncated(od, zones, q).first()[0] is True
    assert is_truncated(od, zones, FlowQuery(level="taz", cap=3)).first()[0] is False
    assert not ranked_flows(od, zones, FlowQuery(level="taz", cap=3)).where("truncated").count()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir)


@pytest.mark.parametrize("level", LEVELS)
def test_trips_are_conserved_at_every_level(tables, level):
    od, zones = tables
    q = FlowQuery(level=level, include_self_loops=True, min_trips=0, cap=None)
    known = zones.base.select(F.col("taz").alias("z"))
    matched = od.join(known, od.from_zone == known.z, "left_semi")
    matched = matched.join(known, matched.to_zone == known.z, "left_semi")
    assert all_flows(od, zones, q).agg(F.sum("trips")).first() == matched.agg(F.sum("trips")).first()


def test_broadcast_and_shuffle_plans_agree(tables):
    od, zones = tables
    wide = ZoneModel(zones.base, broadcast_rows=0)
    assert zones.fits and not wide.fits
    random.seed(7)
    pairs = random.sample(list(itertools.product(LEVELS, LEVELS)), 6)
    for (origin, dest), pre in zip(pairs, itertools.cycle([None, True, False])):
        q = FlowQuery(
            origin_level=origin, dest_level=dest, day=random.choice([None, "friday"]), hour_min=random.randint(0, 12),
            hour_max=random.randint(13, 24), min_trips=random.choice([1, 40]), include_self_loops=random.random() < 0.5, cap=None,
        )
        want, got = all_flows(od, zones, q), all_flows(od, wide, q, pre_aggregate=pre)
        assert as_set(want) == as_set(got)


def test_raising_the_threshold_gives_a_subset(tables):
    od, zones = tables
    low, high = (as_set(flow_rollup(od, zones, FlowQuery(level="g250", min_trips=m, cap=None))) for m in (10, 200))
    assert high < low


def test_hash_collisions_do_not_match(spark, zones):
    """The residual check compares ids in full, prefixes included."""
    od = od_table(spark, [("1", "33"), ("11", "3"), ("", "3"), ("1", "3")])
    assert flows(od, zones, level="taz") == {("1", "3", 1.0)}
