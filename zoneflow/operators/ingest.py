"""From raw zone, name and trip tables to the base zone table and the long trips table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.functions import geometry as geo
from zoneflow.functions.ids import normalise_id
from zoneflow.operators.dissolve import with_centroids
from zoneflow.params import DAYS, HOURS, LEVEL_SOURCE

HOUR_COLUMNS = [f"h{hour}" for hour in HOURS]
NAMED_LEVELS = {"g250": "name_250", "g33": "name_33", "g15": "name_15"}


def require_columns(found: list[str], needed: list[str], what: str) -> None:
    missing = [name for name in needed if name not in found]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; found {found}")


def wide_to_long(wide: DataFrame, day: str) -> DataFrame:
    """Melt a wide trip matrix of one day type: `from_zone, to_zone, day, hour, trips`, one row per cell with trips > 0.

    Headers match whatever their case. Cells that are empty, NaN, zero or negative are dropped.
    """
    if day not in DAYS:
        raise ValueError(f"invalid day {day!r}; valid: {list(DAYS)}")
    lowered = wide.toDF(*[name.lower() for name in wide.columns])
    require_columns(lowered.columns, ["fromzone", "tozone", *HOUR_COLUMNS], f"{day} matrix")
    named = lowered.select(
        normalise_id(F.col("fromzone")).alias("from_zone"), normalise_id(F.col("tozone")).alias("to_zone"), *HOUR_COLUMNS
    )
    melted = named.unpivot(["from_zone", "to_zone"], HOUR_COLUMNS, "hour_name", "trips")
    return melted.where((F.col("trips") > 0) & ~F.isnan("trips")).select(
        "from_zone", "to_zone", F.lit(day).alias("day"), F.substring("hour_name", 2, 2).cast("int").alias("hour"), "trips"
    )


def build_od_matrix(wides: Mapping[str, DataFrame]) -> DataFrame:
    """Long trips table of all day types."""
    parts = [wide_to_long(wide, day) for day, wide in wides.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean_boundaries(raw: DataFrame, epsg: int = 4326) -> DataFrame:
    """Zone polygons with canonical columns and ids, in degrees: `taz, g250, g33, g15, city, geometry`."""
    require_columns(raw.columns, [*LEVEL_SOURCE.values(), "geometry"], "boundary table")
    ids = [normalise_id(F.col(source)).alias(level) for level, source in LEVEL_SOURCE.items() if level != "city"]
    return raw.select(
        *ids, F.trim(F.col(LEVEL_SOURCE["city"])).alias("city"), geo.to_degrees(F.col("geometry"), epsg).alias("geometry")
    )


def first_per_id(rows: DataFrame, id_column: str, value: str, order: str) -> DataFrame:
    """First value of each id in source order. An aggregate, so repeats of one id are reduced before they move."""
    return rows.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min_by(value, order).alias(value))


def clean_zone_names(raw: DataFrame) -> DataFrame:
    """Names of base zones, unique by id: `taz, zone_name`. Takes `taz, zone_name, src_order`."""
    named = raw.select(normalise_id(F.col("taz")).alias("taz"), "zone_name", "src_order")
    return first_per_id(named, "taz", "zone_name", "src_order")


def clean_level_names(raw: DataFrame) -> DataFrame:
    """Names of one group level, unique by id: `group_id, label`. Takes `id, NAME, src_order`.

    Rows without an id go. Ids stored as floating numbers become whole numbers, but only if every id is a number.
    """
    rows = raw.where(F.col("id").isNotNull()).select(
        F.col("id").cast("string").alias("id"), F.col("NAME").alias("label"), "src_order"
    )
    number = F.col("id").try_cast("double")
    all_numeric = rows.select((F.count_if(number.isNull() | F.isnan(number)) == 0).alias("ok")).scalar()
    group_id = F.when(all_numeric, number.cast("bigint").cast("string")).otherwise(normalise_id(F.col("id")))
    return first_per_id(rows.select(group_id.alias("group_id"), "label", "src_order"), "group_id", "label", "src_order")


def build_zones(
    boundaries: DataFrame, zone_names: DataFrame, level_names: Mapping[str, DataFrame | None] | None = None
) -> DataFrame:
    """Base zone table: polygons with names at every level, centroids in degrees and areas.

    `level_names` maps g250, g33 and g15 to their cleaned names; a level without names is labelled with its ids. Names are
    unique by id, so no join adds rows; the boundaries must be unique by zone (see `duplicate_zones`).
    """
    zones = boundaries.join(zone_names, "taz", "left")
    for level, name in NAMED_LEVELS.items():
        names = (level_names or {}).get(level)
        if names is None:
            zones = zones.withColumn(name, F.col(level))
        else:
            zones = zones.join(names.select(F.col("group_id").alias(level), F.col("label").alias(name)), level, "left")
    return with_centroids(zones).select(
        *LEVEL_SOURCE, "zone_name", *NAMED_LEVELS.values(), "centroid_lat", "centroid_lon", "area", "geometry"
    )
