"""Result files. Each writer is a plain distributed write; a folder holds one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.operators.export import sorted_flow_table
from zoneflow.sources.shapefile import Shapefiles
from zoneflow.sources.workbook import Workbooks


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON features, one per line."""
    features.select("feature").write.mode("overwrite").text(path)


COLLECTION_HEAD, COLLECTION_TAIL = '{"type":"FeatureCollection","features":[', "]}"


def write_collection(features: DataFrame, path: str) -> None:
    """GeoJSON features (`idx`, 0 and on, and `feature`) as one FeatureCollection, written in parallel.

    Head, features and tail are rows of one order that is cut into ranges, one file each, so the files of the folder, put together
    in the order of their names, are the document. No task sorts or writes more than its range. The order is checked afterwards.
    """
    spark = features.sparkSession
    size = features.count()
    comma = F.when(F.col("idx") == 0, F.lit("")).otherwise(F.lit(","))
    rows = features.select(F.col("idx").alias("at"), F.concat(comma, F.col("feature")).alias("value"))
    ends = spark.createDataFrame([(-1, COLLECTION_HEAD), (size, COLLECTION_TAIL)], "at bigint, value string")
    ordered = rows.unionByName(ends).repartitionByRange("at").sortWithinPartitions("at")
    ordered.select("value").write.mode("overwrite").text(path)
    lines = document_lines(spark, path)
    low, high, n = lines.agg(F.min_by("value", "line"), F.max_by("value", "line"), F.count("*")).first()
    if (low, high, n) != (COLLECTION_HEAD, COLLECTION_TAIL, size + 2):
        raise ValueError(f"the files of {path} are not in the order of the document, or lines are missing")


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """`line, value` of a document in several files: lines sort by file name, block and position, as they do when put together."""
    order = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(order.alias("line"), "value")


def write_workbook(table: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A table as .xlsx workbooks, one a partition."""
    table.sparkSession.dataSource.register(Workbooks)
    table.write.format("workbook").option("sheet", sheet).mode("append").save(path)


def write_shapefile(zones: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Text columns and `geometry` as shapefiles, one or more a partition."""
    zones.sparkSession.dataSource.register(Shapefiles)
    zones.write.format("shapefile").option("encoding", encoding).mode("append").save(path)


def write_flows(flows: DataFrame, path: str) -> None:
    """Flow rows as JSON lines."""
    flows.write.mode("overwrite").json(path)


def write_flow_export(table: DataFrame, summary: DataFrame, folder: str) -> None:
    """Labelled flows, in export order, and their summary as CSV."""
    ordered = sorted_flow_table(table).drop("tag") if "tag" in table.columns else table
    ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/flows")
    summary.orderBy("ord").select("key", "value").write.mode("overwrite").option("header", True).csv(f"{folder}/summary")


def write_breakdown_export(table: DataFrame, folder: str) -> None:
    """Breakdown rows as CSV, one folder per tab, in the order of the slices."""
    ordered = table.repartition("tab").sortWithinPartitions("tab", "ord")  # a tab has at most N + 2 rows
    ordered.select("tab", F.col("id"), "label", "trips", "pct").write.mode("overwrite").partitionBy("tab").option(
        "header", True
    ).csv(folder)
