"""Roll-ups of trips and zones that lie in the same buckets."""

from __future__ import annotations

import pytest
from helpers import as_set

from zoneflow import FlowQuery, flow_rollup
from zoneflow.plans import retail_tables as retail
from zoneflow.sources.buckets import read_buckets, write_buckets


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("buckets") / "t")
    od, zones = retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir)
    write_buckets(od, zones.base, folder, 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for zone tables that are too large
    yield folder, od, zones
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("#")[0] for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_no_trip_moves_before_the_first_join(spark, tables):
    folder, od, zones = tables
    for query in (FlowQuery(level="g33", day="weekday", hour_min=7, hour_max=10), FlowQuery(origin_level="g33", dest_level="city")):
        trips, model = read_buckets(spark, folder)
        assert not model.fits
        found = flow_rollup(trips, model, query)
        assert "from_zone" not in moved(found) and "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
        assert as_set(found) == as_set(flow_rollup(od, zones, query))
    plain = flow_rollup(od, type(model)(zones.base, broadcast_rows=0), FlowQuery(level="g33", day="weekday", hour_min=7, hour_max=10))
    assert "from_zone" in moved(plain)


def test_another_session_registers_the_tables(spark, tables):
    folder, od, zones = tables
    trips, _ = read_buckets(spark, folder)
    for table in [t.name for t in spark.catalog.listTables() if t.name.startswith("zoneflow_")]:
        spark.sql(f"DROP TABLE {table}")
    again, model = read_buckets(spark, folder)
    query = FlowQuery(level="g15", day="friday")
    found = flow_rollup(again, model, query)
    assert "from_zone" not in moved(found) and as_set(found) == as_set(flow_rollup(od, zones, query))
