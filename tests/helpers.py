"""Small hand-made tables."""

from __future__ import annotations

from zoneflow.functions.geometry import GEOMETRY_TYPE
from zoneflow.operators.hierarchy import ZoneModel

ZONE_COLUMNS = (
    "taz string, g250 string, g33 string, g15 string, city string, zone_name string, name_250 string, name_33 string, "
    f"name_15 string, geometry {GEOMETRY_TYPE}"
)
OD_COLUMNS = "from_zone string, to_zone string, day string, hour int, trips double"
FLOW_COLUMNS = "tag string, origin_id string, dest_id string, trips double"


def ring(*points):
    return [[float(x), float(y)] for x, y in [*points, points[0]]]


def box(x, y, w=1, h=1):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def zone(taz, g33="A", city="X", name="", geometry=None, g250=None, g15="R"):
    label = name or None
    return (taz, g250 or g33, g33, g15, city, label, g250 or g33, g33 and f"name {g33}", g15, geometry or [[box(0, 0)]])


def model(spark, zones, **options) -> ZoneModel:
    return ZoneModel(spark.createDataFrame(zones, ZONE_COLUMNS), **options)


def od_table(spark, rows):
    full = [(*row, *(("weekday", 8, 1.0)[len(row) - 2:] if len(row) < 5 else ())) for row in rows]
    return spark.createDataFrame(full, OD_COLUMNS)


def flow_table(spark, rows):
    return spark.createDataFrame(rows, FLOW_COLUMNS)


def as_set(df):
    return {tuple(row) for row in df.collect()}
