from __future__ import annotations

import pytest

from zoneflow.params import FlowQuery, clamp_hours, clamp_min_trips, clamp_top_n, parse_ids, resolve_level
from zoneflow.plans.modes import Selection


def test_level_fallback_and_aliases():
    q = FlowQuery(level="TAZ_33", dest_level="CITY")
    assert (q.origin_level, q.dest_level) == ("g33", "city")
    assert resolve_level("TAZ_1270") == resolve_level("taz") == "taz"


@pytest.mark.parametrize("bad", [{}, {"origin_level": "g33"}, {"level": "g99"}, {"level": "g33", "day": "sunday"}, {"level": "g33", "cap": 0}])
def test_rejects(bad):
    with pytest.raises(ValueError):
        FlowQuery(**bad)


def test_empty_day_means_all_days():
    assert FlowQuery(level="g33", day="").day is None


def test_parse_ids():
    assert parse_ids(" a, ,b ,") == ("a", "b")
    assert parse_ids(None) == parse_ids("") == ()
    assert FlowQuery(level="g33", origin_ids="3, 7").origin_ids == ("3", "7")
    assert FlowQuery(level="city", origin_ids=["Tel Aviv, Yafo"]).origin_ids == ("Tel Aviv, Yafo",)


def test_clamps():
    assert clamp_hours(10, 7) == (7, 7)
    assert clamp_hours(30, 30) == (23, 24)
    assert clamp_min_trips(-4) == 0
    assert [clamp_top_n(v) for v in ("2", 25, "7", "7.9", "x", "", 0)] == [3, 20, 7, 7, 3, 3, 3]


def test_selection_rules():
    with pytest.raises(ValueError):
        Selection(ids=["1"], map_level="g33", mode=2)
    with pytest.raises(ValueError):
        Selection(ids=["1", "2"], map_level="g33", counterpart_level="g15", mode=3)
    with pytest.raises(ValueError):
        Selection(ids=["1"], map_level="g33", mode=5)
    assert Selection(ids=["1", "1"], map_level="g33").ids == ("1",)
