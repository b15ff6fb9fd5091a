"""The stored tables: zones per level and the trips table, as parquet under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.functions.geometry import GEOMETRY_TYPE
from zoneflow.functions.skipping import splits, z_order
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import BASE_LEVEL, GROUP_LEVELS, LEVELS, resolve_level

OD_TABLE = "od_matrix"
OD_SCHEMA = "from_zone string, to_zone string, trips double, day string, hour int"
ZONE_SCHEMA = (
    "taz string, g250 string, g33 string, g15 string, city string, zone_name string, name_250 string, name_33 string, "
    f"name_15 string, centroid_lat double, centroid_lon double, area double, geometry {GEOMETRY_TYPE}"
)
GROUP_SCHEMA = f"group_id string, label string, centroid_lat double, centroid_lon double, geometry {GEOMETRY_TYPE}"
ZONE_TABLES = {level: "zones" if level == BASE_LEVEL else f"zones_{level.removeprefix('g')}" for level in LEVELS}


def write_od(od: DataFrame, folder: str, cluster: bool = True, block_bytes: int | None = None) -> str:
    """Write the trips table, one partition folder per day type and hour: 72 at most.

    With `cluster`, rows are range-partitioned by day, hour and then along a curve through both ends, so that a task writes to few
    folders, files, row groups and pages hold narrow ranges of origins and of destinations, and a hot zone spreads over as many tasks
    as its pairs fill. `block_bytes` is the size of a row group; smaller ones let more be skipped.
    """
    path = f"{folder}/{OD_TABLE}"
    if cluster:
        curve = z_order(F.col("from_zone"), F.col("to_zone"), splits(od, "from_zone", "to_zone"))
        keys = ["day", "hour", "curve", "from_zone", "to_zone"]
        od = od.withColumn("curve", curve).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("curve")
    writer = od.write.mode("overwrite").partitionBy("day", "hour")
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).parquet(path)
    return path


def read_od(spark: SparkSession, folder: str) -> DataFrame:
    """The trips table, also registered as the view `od_matrix`."""
    od = spark.read.schema(OD_SCHEMA).parquet(f"{folder}/{OD_TABLE}").select("from_zone", "to_zone", "day", "hour", "trips")
    od.createOrReplaceTempView(OD_TABLE)
    return od


def write_zones(table: DataFrame, folder: str, level: str = BASE_LEVEL) -> str:
    path = f"{folder}/{ZONE_TABLES[resolve_level(level)]}"
    table.write.mode("overwrite").parquet(path)
    return path


def read_zones(spark: SparkSession, folder: str, level: str = BASE_LEVEL) -> DataFrame:
    level = resolve_level(level)
    return spark.read.schema(ZONE_SCHEMA if level == BASE_LEVEL else GROUP_SCHEMA).parquet(f"{folder}/{ZONE_TABLES[level]}")


def read_zone_model(spark: SparkSession, folder: str) -> ZoneModel:
    """Base zones and all group tables."""
    return ZoneModel(read_zones(spark, folder), {level: read_zones(spark, folder, level) for level in GROUP_LEVELS})
