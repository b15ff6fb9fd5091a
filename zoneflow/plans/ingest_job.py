"""Batch ingestion: raw files to the stored tables, then a quality report over what was written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from zoneflow.operators import ingest
from zoneflow.operators.outline import group_tables
from zoneflow.operators.quality import duplicate_zones, quality_summary
from zoneflow.params import DAYS, GROUP_LEVELS
from zoneflow.sources import readers, store


def load_zones(
    spark: SparkSession, boundaries: str, zone_names: str, level_names: Mapping[str, str] | None = None,
    epsg: int = 4326, layout: str = "lines", encoding: str = "UTF-8", boundary_encoding: str = "UTF-8",
) -> DataFrame:
    """Base zone table from its raw files.

    Names come as CSV files or, as the source ships them, as one workbook: its first sheet names the zones, and the sheets "250", "33" and
    "15" name the groups unless `level_names` tells otherwise.
    """
    polygons = ingest.clean_boundaries(readers.read_boundaries(spark, boundaries, layout, boundary_encoding), epsg)
    names = ingest.clean_zone_names(readers.read_zone_names(spark, zone_names, encoding))
    levels = {}
    for level in ingest.NAMED_LEVELS:
        path = (level_names or {}).get(level, zone_names if readers.is_workbook(zone_names) else None)
        sheet = readers.read_level_names(spark, path, encoding, level.removeprefix("g") if path == zone_names else 0)
        levels[level] = None if sheet is None else ingest.clean_level_names(sheet)
    return ingest.build_zones(polygons, names, levels)


def ingest_files(
    spark: SparkSession, matrices: Mapping[str, str], boundaries: str, zone_names: str, output: str,
    level_names: Mapping[str, str] | None = None, epsg: int = 4326, layout: str = "lines", encoding: str = "UTF-8", boundary_encoding: str = "UTF-8",
) -> DataFrame:
    """Run the whole ingestion and return its one-row quality summary.

    `matrices` maps each day type to its wide CSV. Fails if a zone occurs twice, as its trips would count twice.
    """
    if set(matrices) != set(DAYS):
        raise ValueError(f"need one matrix for each of {list(DAYS)}")
    zones = load_zones(spark, boundaries, zone_names, level_names, epsg, layout, encoding, boundary_encoding)
    store.write_zones(zones, output)
    base = store.read_zones(spark, output)
    repeated = [row["taz"] for row in duplicate_zones(base).orderBy("taz").limit(20).collect()]
    if repeated:
        raise ValueError(f"zones occur more than once: {repeated}")
    for level, table in group_tables(base, GROUP_LEVELS).items():
        store.write_zones(table, output, level)

    od = ingest.build_od_matrix({day: readers.read_od_csv(spark, path, encoding) for day, path in matrices.items()})
    store.write_od(od, output)
    return quality_summary(store.read_od(spark, output), store.read_zone_model(spark, output))
