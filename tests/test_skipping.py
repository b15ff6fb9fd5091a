"""Trips laid out along both ends, and how much of them a selection reads."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
from helpers import as_set, box, model, zone
from pyspark.sql import functions as F

from zoneflow import FlowQuery, flow_rollup
from zoneflow.functions import skipping
from zoneflow.sources import store


def test_codes_sort_like_texts(spark):
    ids = ["", "1", "10", "2", "9", "100", "A", "a", "é", "קריה", "long id 1", "long id 2"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", skipping.code(F.col("id")).alias("code")).collect()
    by_text = sorted(rows, key=lambda r: r.id.encode())
    assert [r.code for r in by_text] == sorted(r.code for r in rows)


def test_ranges_hold_every_id():
    draw = random.Random(2)
    for _ in range(50):
        ids = [str(draw.randint(0, 5000)) for _ in range(draw.randint(1, 60))]
        found = skipping.ranges(ids, 5)
        assert len(found) <= 5 and all(any(a <= i <= b for a, b in found) for i in ids)
    assert skipping.ranges(["7", "700", "8"], 2) == [("7", "700"), ("8", "8")] and skipping.ranges([]) == []


def groups_read(folder, column, ids):
    """Row groups whose range of a column meets the ranges of some ids, and all."""
    met = every = 0
    for path in folder.rglob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
            stats = next(c.statistics for c in columns if c.path_in_schema == column)
            every += 1
            met += any(stats.min <= b and stats.max >= a for a, b in skipping.ranges(ids))
    return met, every


def test_a_selection_of_either_end_reads_a_part(spark, tmp_path):
    n = 400
    trips = spark.range(120_000).select(
        (F.xxhash64("id", F.lit(1)) % n).alias("a"), (F.xxhash64("id", F.lit(2)) % n).alias("b"), F.lit(1.0).alias("trips"))
    od = trips.select(F.abs("a").cast("string").alias("from_zone"), F.abs("b").cast("string").alias("to_zone"), F.lit("weekday").alias("day"), F.lit(8).alias("hour"), "trips")
    store.write_od(od, str(tmp_path), block_bytes=1 << 14)
    for column in ("from_zone", "to_zone"):
        met, every = groups_read(tmp_path, column, ["17"])
        assert every >= 16 and met <= 0.4 * every, (column, met, every)

    zones = model(spark, [zone(str(i), "A" if i in (17, 230) else "B", geometry=[[box(i, 0)]]) for i in range(n)])
    stored = store.read_od(spark, str(tmp_path))
    for query in (FlowQuery(level="taz", origin_ids=["17"]), FlowQuery(level="taz", dest_ids=["17", "230"]), FlowQuery(level="g33", origin_ids=["A"], include_self_loops=True)):
        found = flow_rollup(stored, zones, query)
        assert as_set(found) == as_set(flow_rollup(od, zones, query))
        text = found._jdf.queryExecution().executedPlan().toString()
        column = "from_zone" if query.origin_ids else "to_zone"
        assert f"EqualTo({column},17)" in text or f"({column}" in text.split("DataFilters: [")[1]
