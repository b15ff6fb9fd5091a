from __future__ import annotations

import pytest
from helpers import as_set, model, od_table, zone
from pyspark.sql import functions as F

from zoneflow import FlowQuery, ZoneModel, flow_rollup, flow_set
from zoneflow.functions.scale import top_per_group
from zoneflow.plans import retail_tables as retail
from zoneflow.plans.modes import Selection, is_truncated


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir)


def run(tables, **params):
    base = {"ids": ["3", "7", "11"], "map_level": "g33", "include_self_loops": True}
    return flow_set(*tables, Selection(**{**base, **params}))


def test_empty_selection_has_no_flows(tables):
    assert run(tables, ids=[]).count() == 0


def test_known_sizes(tables):
    got = {r["tag"]: (r["n"], r["t"]) for r in run(tables, mode=4).groupBy("tag").agg(
        F.count("*").alias("n"), F.sum("trips").alias("t")).collect()}
    assert got == {"internal": (9, 21973.0), "outgoing": (63, 135693.0), "incoming": (66, 127049.0)}


def test_combined_is_internal_plus_external(tables):
    combined, inner, outer = (as_set(run(tables, mode=m)) for m in (4, 2, 3))
    assert combined == inner | outer and not inner & outer


def test_external_directions(tables):
    out, inc, both = (as_set(run(tables, mode=3, direction=d)) for d in ("outgoing", "incoming", "both"))
    assert out | inc == both
    assert {t for t, *_ in out} == {"outgoing"} and {t for t, *_ in inc} == {"incoming"}


def test_outgoing_is_incoming_of_the_complement(tables):
    od, zones = tables
    rest = [r["g33"] for r in zones.base.select("g33").distinct().collect() if r["g33"] not in ("3", "7", "11")]
    ours = {row[1:] for row in as_set(run(tables, mode=3, direction="outgoing"))}
    theirs = {row[1:] for row in as_set(run(tables, mode=3, direction="incoming", ids=rest))}
    assert ours == theirs


def test_single_zone_counts_a_self_loop_twice(spark):
    zones = model(spark, [zone("1", "A"), zone("2", "B")])
    od = od_table(spark, [("1", "1"), ("1", "2")])
    s = Selection(ids=["A"], map_level="g33", include_self_loops=True)
    assert as_set(flow_set(od, zones, s)) == {("outgoing", "A", "A", 1.0), ("outgoing", "A", "B", 1.0), ("incoming", "A", "A", 1.0)}


def test_destination_role_ignores_the_mode(tables):
    od, zones = tables
    want = flow_rollup(od, zones, FlowQuery(origin_level="g15", dest_level="g33", day="weekday", dest_ids=["3", "7"]))
    for mode in (1, 4):
        s = Selection(ids=["3", "7"], map_level="g33", counterpart_level="g15", role="destination", mode=mode)
        assert as_set(flow_set(od, zones, s)) == {("incoming", *row) for row in as_set(want)}


def test_cap_per_tag_and_flag(tables):
    flagged = flow_set(*tables, Selection(ids=["3", "7", "11"], map_level="g33", mode=4, include_self_loops=True, cap=20), with_flag=True)
    cut = {r["tag"]: (r["n"], r["cut"]) for r in flagged.groupBy("tag").agg(F.count("*").alias("n"), F.max("truncated").alias("cut")).collect()}
    assert cut == {"internal": (9, False), "outgoing": (20, True), "incoming": (20, True)}
    assert is_truncated(flagged).first()[0] is True
    top = as_set(run(tables, mode=4, cap=20))
    assert top == as_set(flagged.drop("truncated"))
    full = run(tables, mode=4, cap=None).where("tag = 'outgoing'").orderBy(F.desc("trips"), "origin_id", "dest_id").limit(20)
    assert {r for r in top if r[0] == "outgoing"} == as_set(full)


def test_salted_ranking_equals_plain_ranking(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 10007).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    many = top_per_group(rows, ["g"], order, 1500)  # past the optimizer's threshold: salted
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5000")
    try:
        assert as_set(many) == as_set(top_per_group(rows, ["g"], order, 1500))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


@pytest.mark.parametrize("params", [
    {"ids": ["3"], "counterpart_level": "g250"}, {"ids": ["3", "7"]}, {"ids": ["3"], "counterpart_level": "city", "include_self_loops": True},
    {"ids": ["3"], "direction": "incoming"}, {"mode": 2}, {"mode": 3}, {"mode": 4, "include_self_loops": True},
])
def test_fused_and_separate_parts_agree(tables, params):
    od, zones = tables
    s = Selection(**{"ids": ["3", "7", "11"], "map_level": "g33", "cap": None, **params})
    assert as_set(flow_set(od, zones, s)) == as_set(flow_set(od, ZoneModel(zones.base, broadcast_rows=0), s))
