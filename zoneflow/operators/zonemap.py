"""Zone features of a level as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.functions.scale import sequential_index
from zoneflow.operators.flowmap import feature


def zone_features(zones: DataFrame) -> DataFrame:
    """`idx, id, label, feature` in id order. Takes `id, label, centroid_lat, centroid_lon, geometry`.

    A geometry of one polygon becomes a Polygon feature, any other a MultiPolygon.
    """
    indexed = sequential_index(zones, "id")
    properties = F.struct("id", "label", "centroid_lat", "centroid_lon", "idx")
    single = feature("Polygon", F.col("geometry")[0], properties)
    multi = feature("MultiPolygon", F.col("geometry"), properties)
    text = F.when(F.size("geometry") == 1, single).otherwise(multi)
    return indexed.select("idx", "id", "label", text.alias("feature"))
