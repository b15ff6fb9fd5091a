"""Search by posting lists against the scan of all zones."""

from __future__ import annotations

import random

import pytest
from helpers import box, model, zone

from zoneflow.operators.export import search_zones
from zoneflow.operators.search_index import search_index, write_index


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(9)
    words = ["Haifa", "north", "קריית", "ים", "Old  Town", "a-b", "ÄÖ", "aaaa"]
    zones = [zone(f"{i:03d}", f"G{i % 9}", name=" ".join(draw.choice(words) for _ in range(draw.randint(0, 3))), geometry=[[box(i, 0)]]) for i in range(120)]
    known, folder = model(spark, zones), str(tmp_path_factory.mktemp("index"))
    write_index(known, folder, ["taz", "g33"])
    return known, folder


def test_equal_to_the_scan(spark, tables):
    zones, folder = tables
    for text in ("ha", "HAIFA", "north ha", "קר", "ם ק", "  ", "d  t", "00", "017", "aaa", "aaaaa", "äö", "b", "", "zz", "a-b a", "ifa0"):
        for selected in ((), ("003", "017", "004")):
            expected = [tuple(r) for r in search_zones(zones, "taz", text, selected).collect()]
            assert [tuple(r) for r in search_index(spark, folder, "taz", text, selected).collect()] == expected, text
    assert [tuple(r) for r in search_index(spark, folder, "g33", "ame g7").collect()] == [tuple(r) for r in search_zones(zones, "g33", "ame g7").collect()] != []


def test_reads_postings_of_its_letters_only(spark, tables):
    _, folder = tables
    text = search_index(spark, folder, "taz", "haifa")._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "In(gram, [aif,hai,ifa])" in text and "level" in text.split("PartitionFilters: [")[1].split("]")[0]
