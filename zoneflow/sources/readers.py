"""Raw input files as DataFrames. Every schema is explicit: nothing is inferred from data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.functions.geometry import GEOMETRY_TYPE
from zoneflow.operators.ingest import HOUR_COLUMNS, require_columns
from zoneflow.params import LEVEL_SOURCE
from zoneflow.sources.shapefile import Shapefiles
from zoneflow.sources.workbook import Workbooks

# Positions of the id and name columns in the zone name sheet.
NAME_ID_AT, NAME_TEXT_AT = 0, 6


# The encodings that Spark reads whatever its settings.
STANDARD_ENCODINGS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")
LEGACY_CHARSETS = "spark.sql.legacy.javaCharsets"


def require_encoding(spark: SparkSession, encoding: str) -> None:
    """Raises where this session would not read an encoding such as iso-8859-8 or cp1255."""
    if encoding.upper() not in STANDARD_ENCODINGS and str(spark.conf.get(LEGACY_CHARSETS, "false")).lower() != "true":
        raise ValueError(f"encoding {encoding!r} needs the setting {LEGACY_CHARSETS}=true; without it Spark reads {', '.join(STANDARD_ENCODINGS)} only")


def _headers(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """`file, names`: the first line of every CSV file, split into names, found by one scan however many files there are.

    Only the first blocks of files are looked at, and of a block only the line that comes first moves. Files without a line have no row.
    """
    lines = spark.read.option("header", False).option("encoding", encoding).schema(
        T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(MOST_NAMES)])
    ).csv(path)
    first = lines.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.array(*lines.columns).alias("names")
    )
    return first.groupBy("file").agg(F.min_by("names", "at").alias("names")).select("file", F.array_compact("names").alias("names"))


#: Columns of a trip matrix that are looked at for its header.
MOST_NAMES = 64


def read_od_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Wide trip matrix of one day type: text zone ids and double hours, columns in any order and case.

    Files of one folder may order their columns differently: files of equal headers are read together. A cell that is no number fails
    the read, as does a header that differs from the one a file is read by.
    """
    require_encoding(spark, encoding)
    grouped = _headers(spark, path, encoding).groupBy("names").agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups = sorted((tuple(row["names"]), row["files"]) for row in grouped.collect())  # paths only, as Spark lists them itself
    if not groups:
        require_columns([], ["fromzone", "tozone", *HOUR_COLUMNS], path)
    return reduce(DataFrame.unionByName, [_od_files(spark, paths, header, encoding) for header, paths in groups])


def _od_files(spark: SparkSession, paths: list[str], header: tuple[str, ...], encoding: str) -> DataFrame:
    """Files of one header; the names that matter come in lower case."""
    wanted = ["fromzone", "tozone", *HOUR_COLUMNS]
    require_columns([name.lower() for name in header], wanted, paths[0])
    kinds = {name: T.DoubleType() for name in HOUR_COLUMNS}
    schema = T.StructType([T.StructField(name, kinds.get(name.lower(), T.StringType())) for name in header])
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("encoding", encoding)
    first = {name.lower(): name for name in reversed(header)}
    return reader.option("enforceSchema", False).csv(paths).select(*[F.col(f"`{first[name]}`").alias(name) for name in wanted])


def _source_order() -> Column:
    """Sorts like the rows of the files: by file, then block, then position inside the block."""
    return F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def _read_sheet(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    require_encoding(spark, encoding)
    return spark.read.option("header", True).option("encoding", encoding).option("quote", '"').csv(path)


def is_workbook(path: str) -> bool:
    """Whether names come from a workbook, or a folder of workbooks, by the ending."""
    return path.lower().rstrip("/").endswith(".xlsx")


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """Rows of a sheet (its name, or its position from 0) of one or more workbooks: `file, row, cells`. No rows if there is no such sheet."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbook").option("sheet", sheet if isinstance(sheet, str) else f"#{sheet}").load(path)


def read_zone_names(spark: SparkSession, path: str, encoding: str = "UTF-8", sheet: str | int = 0) -> DataFrame:
    """Zone name sheet, by column position: `taz, zone_name, src_order`. A CSV, or a sheet of a workbook (.xlsx).

    The sub-header below the header needs no special care: its id matches no zone.
    """
    if is_workbook(path):
        rows = read_workbook(spark, path, sheet).where("row > 1")
        cell = lambda at: F.try_element_at("cells", F.lit(at + 1))
        return rows.select(cell(NAME_ID_AT).alias("taz"), cell(NAME_TEXT_AT).alias("zone_name"), F.struct("file", "row").alias("src_order"))
    sheet_rows = _read_sheet(spark, path, encoding)
    if len(sheet_rows.columns) <= NAME_TEXT_AT:
        raise ValueError(f"{path} needs at least {NAME_TEXT_AT + 1} columns; found {sheet_rows.columns}")
    taz, name = sheet_rows.columns[NAME_ID_AT], sheet_rows.columns[NAME_TEXT_AT]
    return sheet_rows.select(F.col(f"`{taz}`").alias("taz"), F.col(f"`{name}`").alias("zone_name"), _source_order().alias("src_order"))


def read_level_names(spark: SparkSession, path: str | None, encoding: str = "UTF-8", sheet: str | int = 0) -> DataFrame | None:
    """Name sheet of a group level: `id, NAME, src_order`. The id is the first column not called NAME. A CSV, or a sheet of a workbook.

    None if there is no sheet or it lacks either column; ids then serve as labels.
    """
    if path is None:
        return None
    if is_workbook(path):
        rows = read_workbook(spark, path, sheet)
        head = rows.where("row = 1").select("cells").head()
        names = [name or "" for name in head["cells"]] if head else []
    else:
        rows = _read_sheet(spark, path, encoding)
        names = rows.columns
    found = {name.strip(): at for at, name in reversed(list(enumerate(names)))}
    ids = [at for at, name in enumerate(names) if name.strip() and name.strip().upper() != "NAME"]
    if not ids or "NAME" not in found:
        return None
    if is_workbook(path):
        cells = [F.try_element_at("cells", F.lit(at + 1)) for at in (ids[0], found["NAME"])]
        return rows.where("row > 1").select(cells[0].alias("id"), cells[1].alias("NAME"), F.struct("file", "row").alias("src_order"))
    cells = [F.col(f"`{names[at]}`") for at in (ids[0], found["NAME"])]
    return rows.select(cells[0].alias("id"), cells[1].alias("NAME"), _source_order().alias("src_order"))


def read_shapefile(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All attributes as text, and `geometry`, of a .shp file or a folder of them."""
    spark.dataSource.register(Shapefiles)
    return spark.read.format("shapefile").option("encoding", encoding).load(path)


def read_boundaries(spark: SparkSession, path: str, layout: str = "lines", encoding: str = "UTF-8") -> DataFrame:
    """Zone polygons from GeoJSON or shapefiles: the five level columns as text and `geometry` as a multipolygon array.

    A coordinate that is no number, or a geometry that is neither Polygon nor MultiPolygon, fails the read.

    `layout="shapefile"` reads .shp files, each in parallel. `layout="lines"` reads GeoJSON with one feature per line and splits large files. `layout="collection"` reads FeatureCollection
    documents; such a document is one record, so a large zone set should come as lines or as many documents.
    """
    feature = T.StructType([
        T.StructField("properties", T.StructType([T.StructField(c, T.StringType()) for c in LEVEL_SOURCE.values()])),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType()),
        ])),
    ])
    if layout == "shapefile":
        shapes = read_shapefile(spark, path, encoding)
        require_columns(shapes.columns, [*LEVEL_SOURCE.values(), "geometry"], path)
        return shapes.select(*LEVEL_SOURCE.values(), "geometry")
    require_encoding(spark, encoding)
    if layout == "lines":
        features = spark.read.schema(feature).options(mode="FAILFAST", encoding=encoding, lineSep="\n").json(path)
    elif layout == "collection":
        document = T.StructType([T.StructField("features", T.ArrayType(feature))])
        features = spark.read.schema(document).options(multiLine=True, mode="FAILFAST", encoding=encoding).json(path)
        features = features.select(F.inline("features"))
    else:
        raise ValueError(f"invalid layout {layout!r}")
    strict = {"mode": "FAILFAST"}
    kind, shapes = F.col("geometry.type"), F.col("geometry.coordinates")
    polygon = F.from_json(shapes, "array<array<array<double>>>", strict)
    multi = F.from_json(shapes, GEOMETRY_TYPE, strict)
    refused = F.raise_error(F.concat(F.lit("neither Polygon nor MultiPolygon: "), kind))
    shape = F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", multi).when(kind.isNotNull(), refused)
    return features.select("properties.*", shape.alias("geometry"))
