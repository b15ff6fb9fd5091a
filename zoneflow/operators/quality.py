"""Data-quality report over a zone table and a trips table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import BASE_LEVEL, DAYS, HOURS, LEVELS

MISSING_SHOWN = 20  # fixed value: how many unmatched ids the report lists


def od_zone_ids(od: DataFrame) -> DataFrame:
    """Distinct zone ids among origins and destinations: `zone_id`."""
    return od.select(F.explode(F.array("from_zone", "to_zone")).alias("zone_id")).distinct()


def unmatched_zones(od: DataFrame, zones: ZoneModel) -> DataFrame:
    """Zone ids of the trips table that the zone table lacks."""
    known = zones.base.select(F.col(BASE_LEVEL).alias("zone_id"))
    return od_zone_ids(od).join(zones.hint(known), "zone_id", "left_anti")


def first_unmatched(od: DataFrame, zones: ZoneModel, limit: int = MISSING_SHOWN) -> DataFrame:
    return unmatched_zones(od, zones).orderBy("zone_id").limit(limit)


def quality_summary(od: DataFrame, zones: ZoneModel) -> DataFrame:
    """One row with sizes, days, trip range and match counts."""
    facts = od.agg(
        F.count("*").alias("n_rows"), F.count_distinct("day").alias("n_days"),
        F.array_join(F.array_sort(F.collect_set("day")), ",").alias("days"),
        F.min("trips").alias("min_trips"), F.max("trips").alias("max_trips"),
    )
    known = zones.hint(zones.base.select(F.col(BASE_LEVEL).alias("zone_id"), F.lit(True).alias("__known")))
    ids = od_zone_ids(od).join(known, "zone_id", "left").agg(
        F.count("*").alias("n_od_zones"), F.count_if(F.col("__known").isNull()).alias("n_missing")
    )
    table = zones.base.agg(F.count("*").alias("n_zones"), F.count_if(F.col("zone_name").isNull()).alias("n_unnamed"))
    return facts.select(
        "*",
        ids.select("n_od_zones").scalar().alias("n_od_zones"), table.select("n_zones").scalar().alias("n_zones"),
        ids.select("n_missing").scalar().alias("n_missing"), table.select("n_unnamed").scalar().alias("n_unnamed"),
    )


def duplicate_zones(base: DataFrame) -> DataFrame:
    """Base zones that occur more than once; each would double the trips through it."""
    return base.groupBy(BASE_LEVEL).agg(F.count("*").alias("n")).where("n > 1")


def od_metadata(od: DataFrame) -> DataFrame:
    """One row describing the parameters a query may use. The lower trips bound is fixed; `trips_lowest` is the real one."""
    return od.agg(F.max("trips").alias("trips_max"), F.min("trips").alias("trips_lowest")).select(
        F.lit(len(DAYS)).cast("bigint").alias("n_days"), F.lit(",".join(DAYS)).alias("days"),
        F.lit(HOURS[0]).cast("bigint").alias("hour_min"), F.lit(HOURS[-1]).cast("bigint").alias("hour_max"),
        F.lit(1.0).alias("trips_min"), "trips_max", "trips_lowest",
        F.lit(len(LEVELS)).cast("bigint").alias("n_levels"),
    )
