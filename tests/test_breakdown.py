from __future__ import annotations

import pytest
from helpers import as_set, flow_table, model, zone

from zoneflow import texts
from zoneflow.operators import breakdown


@pytest.fixture(scope="module")
def zones(spark):
    return model(spark, [zone(str(i), f"Z{i}") for i in range(9)])


@pytest.fixture(scope="module")
def flows(spark):
    rows = [("outgoing", "Z0", f"Z{i}", float(10 * i)) for i in range(1, 9)]
    rows += [("internal", "Z0", "Z0", 3.0), ("internal", "Z0", "Z1", 4.0), ("incoming", "Q", "Z0", 5.0)]
    return flow_table(spark, rows)


def test_top_n_folds_the_rest(flows, zones):
    got = breakdown.slices(flows, zones, ["outgoing"], True, "g33", top_n=5).orderBy("ord").collect()
    assert [(r["id"], r["trips"], r["n_zones"]) for r in got] == [
        ("Z8", 80.0, 1), ("Z7", 70.0, 1), ("Z6", 60.0, 1), ("Z5", 50.0, 1), ("Z4", 40.0, 1), ("others", 60.0, 3)]
    assert got[0]["label"] == "name Z8" and got[-1]["label"] == "אחרים (3 אזורים)"


def test_no_others_row_when_nothing_is_left(flows, zones):
    assert breakdown.slices(flows, zones, ["outgoing"], True, "g33", top_n=8).where("id = 'others'").count() == 0


def test_a_zone_called_others_stays_a_zone(spark, zones):
    flows = flow_table(spark, [("outgoing", "Z0", "others", 9.0)] + [("outgoing", "Z0", f"Z{i}", 1.0) for i in range(1, 5)])
    got = {(r["id"], r["trips"], r["ord"]) for r in breakdown.slices(flows, zones, ["outgoing"], True, "g33", top_n=3).collect()}
    assert got == {("others", 9.0, 1), ("Z1", 1.0, 2), ("Z2", 1.0, 3), ("others", 2.0, 4)}


def test_unknown_zone_is_labelled_with_its_id(flows, zones):
    row = breakdown.slices(flows, zones, ["incoming"], True, "g33", top_n=5).first()
    assert (row["id"], row["label"]) == ("Q", "Q")


def test_overview_splits_internal_only_with_self_loops(flows):
    assert {(r["id"], r["trips"]) for r in breakdown.overview(flows, True).collect()} == {
        ("outgoing", 360.0), ("incoming", 5.0), ("inter_selected", 4.0), ("intra_zone", 3.0)}
    assert ("internal", 7.0) in {(r["id"], r["trips"]) for r in breakdown.overview(flows, False).collect()}


def test_tabs():
    assert breakdown.tabs_of(4) == ["overview", "outgoing", "incoming", "internal_origins", "internal_dests"]
    assert breakdown.tabs_of(2) == ["origin", "dest"]
    assert breakdown.tabs_of(1, "destination") == ["incoming"]
    assert breakdown.tabs_of(3, direction="outgoing") == ["outgoing"]
    assert breakdown.tabs_of(3) == ["outgoing", "incoming"]


def test_shares_angles_and_export(flows, zones):
    rows = breakdown.slices(flows, zones, breakdown.tabs_of(4), True, "g33", top_n=3)
    for tab in ("overview", "outgoing", "incoming", "internal_origins", "internal_dests"):
        pct = [r["pct"] for r in breakdown.shares(rows).where(f"tab = '{tab}'").collect()]
        assert abs(sum(pct) - 100) < 0.2
    arcs = breakdown.angles(rows).where("tab = 'outgoing'").orderBy("ord").collect()
    assert arcs[0]["start_deg"] == 0 and abs(arcs[-1]["start_deg"] + arcs[-1]["sweep_deg"] - 360) < 1e-9
    assert all(a["show_label"] for a in arcs)
    table = {tuple(r) for r in breakdown.export_table(rows).where("tab = 'outgoing'").drop("tab").collect()}
    assert (5, "", texts.TOTAL, 360, 100.0) in table
    assert (4, "—", "אחרים (5 אזורים)", 150, 41.7) in table


def test_totals_of_nothing(flows):
    assert tuple(breakdown.flow_totals(flows.where("false")).first()) == (0, 0, None, None)
    assert as_set(breakdown.trips_by(flows.where("tag = 'internal'"), "origin_id")) == {("Z0", 7.0)}
    with pytest.raises(ValueError):
        breakdown.trips_by(flows, "tag")
