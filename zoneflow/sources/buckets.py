"""Trips and zones stored in the same buckets, for zone tables too large to broadcast.

Both tables are bucketed and sorted by the zone id, so the first join of a roll-up reads matching buckets side by side: no trip moves before
it has its first group. Tables live below a folder; a session that does not know them registers them from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.sources.store import ZONE_SCHEMA

TRIPS_SCHEMA = "to_zone string, hour int, trips double, from_zone string, day string"
LAYOUT_SCHEMA = "name string, buckets int"


def write_buckets(od: DataFrame, base: DataFrame, folder: str, buckets: int) -> None:
    """Writes both tables with `buckets` buckets each; a bucket is one file a day type. Pick as many as keep a file near 128 MB or more."""
    spark, name = od.sparkSession, f"zoneflow_{uuid.uuid4().hex}"
    trips = od.select("to_zone", "hour", "trips", "from_zone", "day").repartition(buckets, "from_zone")
    trips.write.bucketBy(buckets, "from_zone").sortBy("from_zone").partitionBy("day").option("path", f"{folder}/trips").saveAsTable(f"{name}_trips")
    columns = [part.split()[0] for part in ZONE_SCHEMA.split(", ")]
    known = base.select(*[c if c in base.columns else F.lit(None).alias(c) for c in columns]).repartition(buckets, "taz")
    known.write.bucketBy(buckets, "taz").sortBy("taz").option("path", f"{folder}/zones").saveAsTable(f"{name}_zones")
    spark.createDataFrame([(name, buckets)], LAYOUT_SCHEMA).coalesce(1).write.parquet(f"{folder}/layout")


def read_buckets(spark: SparkSession, folder: str) -> tuple[DataFrame, ZoneModel]:
    """The trips, and the zones as a model that is joined by its buckets, never broadcast."""
    layout = spark.read.schema(LAYOUT_SCHEMA).parquet(f"{folder}/layout").first()
    name, n = layout["name"], layout["buckets"]
    if not spark.catalog.tableExists(f"{name}_trips"):
        spark.sql(
            f"CREATE TABLE {name}_trips ({TRIPS_SCHEMA}) USING parquet PARTITIONED BY (day) "
            f"CLUSTERED BY (from_zone) SORTED BY (from_zone) INTO {n} BUCKETS LOCATION '{folder}/trips'"
        )
        spark.catalog.recoverPartitions(f"{name}_trips")
    if not spark.catalog.tableExists(f"{name}_zones"):
        spark.sql(f"CREATE TABLE {name}_zones ({ZONE_SCHEMA}) USING parquet CLUSTERED BY (taz) SORTED BY (taz) INTO {n} BUCKETS LOCATION '{folder}/zones'")
    od = spark.table(f"{name}_trips").select("from_zone", "to_zone", "day", "hour", "trips")
    return od, ZoneModel(spark.table(f"{name}_zones"), broadcast_rows=0)
