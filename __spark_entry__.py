"""

All queries run over the whole zone and trip tables that `zoneflow.plans.retail_tables` derives from the test tables.
As in production, ingestion writes them once and queries scan what it wrote.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from zoneflow import FlowQuery, flow_rollup, flow_set  # noqa: E402
from zoneflow.functions import geometry as geo  # noqa: E402
from zoneflow.functions.flows import plain_count, rounded_count  # noqa: E402
from zoneflow.functions.scale import scratch_path, sequential_index  # noqa: E402
from zoneflow.operators import breakdown, dissolve, export, flowmap, ingest, outline, quality, zonemap  # noqa: E402
from zoneflow.operators.partial_sums import flows_from_sums  # noqa: E402
from zoneflow.operators.rollup import ranked_flows  # noqa: E402
from zoneflow.operators.search_index import search_index, write_index  # noqa: E402
from zoneflow.params import DAYS, FLOW_CAP, GROUP_LEVELS, LEVEL_SOURCE  # noqa: E402
from zoneflow.plans import retail_tables as retail  # noqa: E402
from zoneflow.plans.modes import COMBINED, EXTERNAL, INTERNAL, SINGLE, Selection  # noqa: E402
from zoneflow.sources import readers, sinks, store  # noqa: E402

try:
    from zoneflow.llm import registry as llm  # noqa: E402
except ModuleNotFoundError:  # the subpackage is optional
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

PICKED = ("3", "7", "11")
MORNING = {"day": "weekday", "hour_min": 7, "hour_max": 10}
GROUP = {"ids": PICKED, "map_level": "g33"}
COMBINED_MORNING = Selection(**GROUP, mode=COMBINED, include_self_loops=True, **MORNING)

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    return queries()["flows_same_level"](spark, SMOKE_DIR)


def _flows(**params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flow_rollup(retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir), FlowQuery(**params))

    return run


def _mode(**params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flow_set(retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir), Selection(**params))

    return run


def _on_flows(
    derive: Callable, selection: Selection = COMBINED_MORNING, with_flag: bool = False, model: Callable = retail.stored_zones
) -> Query:
    """A query derived from the flow set of a selection."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        zones = model(spark, sf_dir)
        return derive(flow_set(retail.stored_od(spark, sf_dir), zones, selection, with_flag), zones)

    return run


def _on_zones(derive: Callable, model: Callable = retail.stored_zones) -> Query:
    return lambda spark, sf_dir: derive(model(spark, sf_dir))


def _on_both(derive: Callable) -> Query:
    return lambda spark, sf_dir: derive(retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir))


def _from_sums(**params) -> Query:
    """Flows answered from stored sums between groups."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        od, zones = retail.stored_od(spark, sf_dir), retail.stored_zones(spark, sf_dir)
        return flows_from_sums(od, zones, retail.stored_sums(spark, sf_dir), FlowQuery(**params))

    return run


# --- ingestion ---------------------------------------------------------------------------------------------------


def _od_ingest_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide CSV files of the three day types, in two column orders, read back and melted."""
    folder, od = scratch_path(spark, "od_wide"), retail.stored_od(spark, sf_dir)
    for day in DAYS:
        wide, odd = retail.od_wide(od, day), F.pmod(F.xxhash64("fromZone"), F.lit(2)) == 1
        for rows, names in ((wide.where(~odd), wide.columns), (wide.where(odd), wide.columns[::-1])):
            rows.select(*names).write.mode("append").option("header", True).csv(f"{folder}/{day}")
    return ingest.build_od_matrix({day: readers.read_od_csv(spark, f"{folder}/{day}") for day in DAYS})


def _od_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "od_roundtrip")
    store.write_od(retail.od_matrix(spark, sf_dir), folder)
    od = store.read_od(spark, folder)
    return od.groupBy("day").agg(F.count("*").alias("n"), F.sum("trips").alias("trips"))


def _zones_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON boundaries and a name sheet with padded and repeated entries, read back, cleaned and joined."""
    folder, zones = scratch_path(spark, "zones_base"), retail.zones(spark, sf_dir)
    raw = {source: F.col(level) for level, source in LEVEL_SOURCE.items()}
    raw["TAZ_1270"] = F.concat(F.lit("0"), "taz")
    raw["CITY"] = F.concat(F.lit(" "), "city", F.lit(" "))
    properties = F.struct(*[column.alias(name) for name, column in raw.items()])
    zones.select(flowmap.feature("Polygon", F.col("geometry")[0], properties)).write.text(f"{folder}/boundaries")

    repeats = F.when(F.col("taz").cast("bigint") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sheet = zones.select("*", F.explode(repeats).alias("copy")).select(
        F.col("taz").alias("TAZ_1270"), F.col("g250").alias("TAZ_250"), F.col("g33").alias("TAZ_33"),
        F.col("g15").alias("TAZ_15"), F.lit("").alias("E"), F.lit("").alias("F"),
        F.when(F.col("copy") == 0, F.col("zone_name")).otherwise("DUP").alias("zone_name"), "copy",
    )
    sheet.orderBy("copy", "TAZ_1270").drop("copy").write.option("header", True).csv(f"{folder}/names")

    boundaries = ingest.clean_boundaries(readers.read_boundaries(spark, f"{folder}/boundaries"))
    names = ingest.clean_zone_names(readers.read_zone_names(spark, f"{folder}/names"))
    return ingest.build_zones(boundaries, names).select("taz", "g250", "g33", "g15", "city", "zone_name")


def _zone_level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level name sheet with float ids, a row without id and repeated ids."""
    folder, nation = scratch_path(spark, "level_names"), retail.table(spark, sf_dir, "nation")
    row = [F.col("n_nationkey").cast("double").alias("id"), F.col("n_name").alias("NAME"), F.col("n_nationkey").alias("src")]
    sheet = nation.select(*row).unionByName(
        nation.where("n_nationkey < 3").select(row[0], F.lit("DUP").alias("NAME"), (F.col("n_nationkey") + 100).alias("src"))
    ).unionByName(nation.where("n_nationkey = 0").select(F.lit(None).cast("double").alias("id"), F.lit("note").alias("NAME"), F.lit(-1).alias("src")))
    sheet.orderBy("src").drop("src").write.option("header", True).csv(folder)
    names = ingest.clean_level_names(readers.read_level_names(spark, folder))
    zones = retail.zones(spark, sf_dir).select(F.col("g33").alias("group_id"))
    return zones.join(names, "group_id", "left").select("group_id", "label").distinct()


# --- breakdowns --------------------------------------------------------------------------------------------------


def _trips_by(tag: str, endpoint: str) -> Query:
    def derive(flows, zones):
        rows = breakdown.trips_by(flows.where(F.col("tag") == tag), endpoint)
        return rows.join(zones.hint(zones.labels(["g33"])), "id", "left").select(
            "id", F.coalesce("label", "id").alias("label"), "trips"
        )

    return _on_flows(derive)


def _outgoing_slices(flows, zones):
    return breakdown.slices(flows, zones, ["outgoing"], True, "g33")


def _angles(flows, zones):
    rows = breakdown.angles(_outgoing_slices(flows, zones))
    degrees = [F.round(name, 6).alias(name) for name in ("start_deg", "sweep_deg", "mid_deg")]
    return rows.select("id", "trips", *degrees, "show_label")


def _export_breakdown(flows, zones):
    rows = breakdown.slices(flows, zones, breakdown.tabs_of(COMBINED), True, "g33")
    return breakdown.export_table(rows).select("tab", "id", "label", "trips", "pct")


# --- geometry ----------------------------------------------------------------------------------------------------


def _zones_dissolved(zones):
    return dissolve.zone_tables(zones.base, GROUP_LEVELS).select(
        "level", F.col("id").alias("group_id"), "label", "n_zones", "area",
        F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"),
    )


def _boundary(zones):
    return dissolve.boundary_lengths(dissolve.boundary_edges(dissolve.group_sides(zones.base, GROUP_LEVELS)))


def _dissolved_polygons(zones):
    """Polygons, vertices and area of the assembled shapes of every group."""
    parts = [
        zones.tables[level].select(
            F.lit(level).alias("level"), "group_id", F.size("geometry").cast("bigint").alias("n_polygons"),
            (F.size(geo.vertices(F.col("geometry"))) - F.size(geo.rings(F.col("geometry")))).cast("bigint").alias("n_vertices"),
            geo.moments(F.col("geometry")).area.alias("area"),
        )
        for level in GROUP_LEVELS
    ]
    return reduce(DataFrame.unionByName, parts)


def _zones_geojson(zones):
    """Features of the g33 groups, parsed back from their text."""
    rows = zones.tables["g33"].withColumnRenamed("group_id", "id")
    parsed = F.from_json("feature", "geometry struct<type: string>, properties struct<id: string, label: string, idx: bigint>")
    polygons = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), geo.GEOMETRY_TYPE)
    return zonemap.zone_features(rows).withColumn("f", parsed).select(
        "idx", "id", "label", F.col("f.geometry.type").alias("kind"), F.col("f.properties.label").alias("feature_label"),
        F.when(F.col("f.geometry.type") == "MultiPolygon", F.size(polygons)).otherwise(1).cast("bigint").alias("n_polygons"),
    )


def _zones_geojson_base(zones):
    rows = zones.base.select(F.col("taz").alias("id"), F.col("zone_name").alias("label"), "centroid_lat", "centroid_lon", "geometry")
    return zonemap.zone_features(rows)


def _zones_reproject(zones):
    """All corners of the zones, projected to web Mercator metres and back."""
    metres = zones.base.select("taz", F.transform("geometry", lambda polygon: F.transform(
        polygon, lambda ring: F.transform(ring, lambda p: F.array(*geo.to_web_mercator(p[0], p[1])))
    )).alias("geometry"))
    rings = metres.select("taz", F.posexplode(geo.rings(geo.to_degrees(F.col("geometry"), 3857))).alias("ring", "points"))
    corners = rings.select("taz", "ring", F.posexplode("points").alias("at", "p"))
    return corners.select("taz", "ring", "at", F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"))


def _zones_datum_shift(zones):
    """All corners of the zones, taken as coordinates on the datum of the national grid, on WGS84."""
    crs = geo.source_crs(2039)
    rings = zones.base.select("taz", F.posexplode(geo.rings(F.col("geometry"))).alias("ring", "points"))
    moved = rings.select("taz", "ring", geo.shifted(F.col("points"), (crs.semi_major, crs.inverse_flattening), crs.shift).alias("points"))
    corners = moved.select("taz", "ring", F.posexplode("points").alias("at", "p"))
    return corners.select("taz", "ring", "at", F.round(F.col("p")[0], 7).alias("lon"), F.round(F.col("p")[1], 7).alias("lat"))


def _zones_union(zones):
    """Perimeter, area and number of polygons of groups whose zones reach half a cell into their neighbours to the right and above."""
    wide = F.transform("geometry", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(
        F.when(p[0] > F.col("low.min_lon"), p[0] + retail.CELL / 2).otherwise(p[0]),
        F.when(p[1] > F.col("low.min_lat"), p[1] + retail.CELL / 2).otherwise(p[1]),
    ))))
    base = zones.base.withColumn("low", geo.bounds(F.col("geometry"))).withColumn("geometry", wide).drop("low", "area")
    sides = dissolve.group_sides(base, ["g33", "city"]).checkpoint()
    lengths = dissolve.boundary_lengths(dissolve.boundary_edges(sides)).drop("n_edges")
    shapes = outline.dissolved_polygons(base, ["g33", "city"], sides).groupBy("level", "group_id").agg(
        F.sum(geo.moments(F.array("polygon")).area).alias("area")
    )
    return lengths.join(shapes, ["level", "group_id"])


def _zones_shapefile(zones):
    """Base zones written as shapefiles, read back in splits, cleaned."""
    spark, folder = zones.base.sparkSession, scratch_path(zones.base.sparkSession, "shapefile")
    raw = zones.base.select(*[F.col(level).alias(source) for level, source in LEVEL_SOURCE.items()], "geometry")
    sinks.write_shapefile(raw, folder)
    found = ingest.clean_boundaries(readers.read_boundaries(spark, folder, layout="shapefile"))
    low = geo.bounds(F.col("geometry"))
    return found.select("taz", "g250", "g33", "g15", "city", low.min_lon.alias("x0"), low.min_lat.alias("y0"), geo.moments(F.col("geometry")).area.alias("area"))


def _zone_names_workbook(zones):
    """Names of the zones through workbooks: written, read by position, cleaned."""
    spark, folder = zones.base.sparkSession, scratch_path(zones.base.sparkSession, "names") + "/names.xlsx"
    empty = [F.lit(None).cast("string").alias(name) for name in "bcdef"]
    sinks.write_workbook(zones.base.select(F.col("taz").cast("bigint").alias("TAZ_1270"), *empty, "zone_name"), folder, "names")
    return ingest.clean_zone_names(readers.read_zone_names(spark, folder, sheet="names"))


def _zones_collection(zones):
    """The lines of one FeatureCollection of all base zones, in the order of the document."""
    spark, folder = zones.base.sparkSession, scratch_path(zones.base.sparkSession, "collection")
    sinks.write_collection(_zones_geojson_base(zones), folder)
    lines = sinks.document_lines(spark, folder)
    return sequential_index(lines, "line", "at").select("at", "value")


def _zone_centroids(zones):
    return dissolve.zone_table(zones.base, "taz").select(F.col("id").alias("taz"), "centroid_lon", "centroid_lat")


def _flow_geometry(flows, zones):
    rounded = [F.round(name, 6).alias(name) for name in ("width", "bearing", "arrow_lon", "arrow_lat")]
    return flowmap.flow_geometry(flows, zones, "g33").select("tag", "origin_id", "dest_id", "trips", *rounded)


def _flow_geojson(flows, zones):
    """Line features parsed back from their text."""
    features = flowmap.line_features(flowmap.flow_geometry(flows, zones, "g33"))
    parsed = F.from_json(
        "feature",
        "geometry struct<type: string, coordinates: array<array<double>>>, "
        "properties struct<trips: double, orig_label: string, dest_label: string>",
    )
    at = F.col("f.geometry.coordinates")
    return features.withColumn("f", parsed).select(
        "tag", "origin_id", "dest_id", F.col("f.geometry.type").alias("kind"),
        F.round(at[0][0], 6).alias("lon1"), F.round(at[0][1], 6).alias("lat1"),
        F.round(at[1][0], 6).alias("lon2"), F.round(at[1][1], 6).alias("lat2"),
        "f.properties.trips", "f.properties.orig_label", "f.properties.dest_label",
    )


def _relevant_zones(flows, zones):
    rows = flowmap.relevant_zones(flows, zones, PICKED, "g33")
    return rows.select("id", "label", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"))


def _flow_display_round(flows, zones):
    trips = F.col("trips") * 13
    return flows.select("tag", "origin_id", "dest_id", plain_count(trips).alias("plain"), rounded_count(trips).alias("rounded"))


def _flow_arrows(flows, zones):
    """Arrow points parsed back from their text."""
    features = flowmap.arrow_features(flowmap.flow_geometry(flows, zones, "g33"))
    parsed = F.from_json("feature", "geometry struct<type: string, coordinates: array<double>>, properties struct<bearing: double>")
    at = F.col("f.geometry.coordinates")
    return features.withColumn("f", parsed).select(
        "tag", "origin_id", "dest_id", F.col("f.geometry.type").alias("kind"), F.round(at[0], 6).alias("lon"), F.round(at[1], 6).alias("lat"),
        F.round("f.properties.bearing", 6).alias("bearing"),
    )


def _zone_label_points(flows, zones):
    features = flowmap.label_points(flowmap.relevant_zones(flows, zones, PICKED, "g33"))
    parsed = F.from_json("feature", "geometry struct<type: string, coordinates: array<double>>, properties struct<label: string>")
    at = F.col("f.geometry.coordinates")
    return features.withColumn("f", parsed).select(
        "id", F.col("f.geometry.type").alias("kind"), F.col("f.properties.label").alias("label"), F.round(at[0], 6).alias("lon"), F.round(at[1], 6).alias("lat")
    )


def _tabs(mode: int, **params) -> Query:
    """All slices of the tabs that a selection shows."""
    selection = Selection(**GROUP, mode=mode, include_self_loops=True, **MORNING, **params)
    tabs = breakdown.tabs_of(mode, selection.role, selection.direction)

    def derive(flows, zones):
        return breakdown.slices(flows, zones, tabs, True, "g33").select("tab", "id", "label", "trips", "n_zones")

    return _on_flows(derive, selection)


# --- sinks: written, read back -------------------------------------------------------------------------------------


def _sink_flows(flows, zones):
    folder = scratch_path(flows.sparkSession, "flows")
    sinks.write_flows(flows, folder)
    return flows.sparkSession.read.schema("tag string, origin_id string, dest_id string, trips double").json(folder)


def _sink_flow_export(flows, zones):
    spark, folder = flows.sparkSession, scratch_path(flows.sparkSession, "flow_export")
    flagged = flows.withColumn("truncated", F.lit(False))
    sinks.write_flow_export(export.flow_table(flows, zones, COMBINED_MORNING), export.summary_table(flagged, zones, COMBINED_MORNING), folder)
    schema = "origin_id string, origin_name string, dest_id string, dest_name string, trips bigint, type string"
    rows = spark.read.schema(schema).option("header", True).csv(f"{folder}/flows")
    summary = spark.read.schema("key string, value string").option("header", True).csv(f"{folder}/summary")
    total = summary.agg(F.count("*").alias("n_summary"))
    return rows.join(F.broadcast(total))


def _sink_breakdown(flows, zones):
    spark, folder = flows.sparkSession, scratch_path(flows.sparkSession, "breakdown_export")
    rows = breakdown.slices(flows, zones, breakdown.tabs_of(COMBINED), True, "g33")
    sinks.write_breakdown_export(breakdown.export_table(rows), folder)
    read = spark.read.schema("id string, label string, trips bigint, pct double, tab string").option("header", True).csv(folder)
    return read.select("tab", F.coalesce("id", F.lit("")).alias("id"), "label", "trips", "pct")


def _sink_features(zones):
    spark, folder = zones.base.sparkSession, scratch_path(zones.base.sparkSession, "features")
    sinks.write_features(_zones_geojson_base(zones), folder)
    return spark.read.text(folder).withColumnRenamed("value", "feature")


def _filter_line(flows, zones):
    count = flows.agg(F.count("*").alias("n_flows"))
    return count.select("n_flows", export.filter_line(COMBINED_MORNING).alias("line"), export.filter_line(ALL_DAYS_SELECTION).alias("every"))


# --- exports -----------------------------------------------------------------------------------------------------


def _flows_labelled(od, zones):
    every = flow_rollup(od, zones, FlowQuery(level="taz"))
    return flowmap.label_flows(every, zones, "taz").select("origin_id", "origin_label", "dest_id", "dest_label", "trips")


def _captions(flows, zones):
    return flowmap.captions(flowmap.label_flows(flows, zones, "g33")).select("tag", "origin_id", "dest_id", "caption")


SUMMARY_SELECTION = Selection(**GROUP, mode=COMBINED, include_self_loops=True, cap=20, **MORNING)


ALL_DAYS_SELECTION = Selection(**GROUP, mode=COMBINED, include_self_loops=True, day=None)


def _export_summary_all_days(flows, zones):
    return export.summary_table(flows, zones, ALL_DAYS_SELECTION)


def _export_summary(flows, zones):
    return export.summary_table(flows, zones, SUMMARY_SELECTION)


def _zone_search_index(zones):
    """The same question as `zone_search`, from the stored posting lists."""
    spark, folder = zones.base.sparkSession, scratch_path(zones.base.sparkSession, "search")
    write_index(zones, folder, ["taz"])
    return search_index(spark, folder, "taz", "00012", ["12"])


def _zone_name_list(zones):
    names = zones.base.select(
        F.col("g33").alias("group_id"), F.col("taz").alias("ord"), F.coalesce("zone_name", "taz").alias("name")
    )
    return export.name_lists(names)


def queries() -> dict[str, Query]:
    return {
        **(llm.queries() if llm else {}),
        "flows_same_level": _flows(level="g33", **MORNING),
        "flows_cross_level": _flows(origin_level="g33", dest_level="city"),
        "flows_with_self_loops": _flows(level="g15", include_self_loops=True, **MORNING),
        "flows_hour_range": _flows(level="g33", hour_min=22, hour_max=24),
        "flows_day_filter": _flows(level="g33", day="saturday"),
        "flows_all_days": _flows(level="g250"),
        "flows_include_ids": _flows(level="g33", origin_ids=PICKED, dest_ids=["1", "2", "5"], **MORNING),
        "flows_exclude_ids": _flows(level="g33", origin_ids=PICKED, exclude_dest_ids=PICKED, **MORNING),
        "flows_min_trips": _flows(origin_level="taz", dest_level="g33", min_trips=100),
        "flows_topk": _on_both(lambda od, zones: ranked_flows(od, zones, FlowQuery(level="taz", cap=FLOW_CAP))),
        "internal_pairs": _on_zones(lambda zones: zones.internal_pairs("g33", "city")),
        "level_lookup": _on_zones(lambda zones: zones.lookups()),
        "od_ingest_long": _od_ingest_long,
        "od_roundtrip": _od_roundtrip,
        "zones_base": _zones_base,
        "zone_level_names": _zone_level_names,
        "quality_summary": _on_both(lambda od, zones: quality.quality_summary(retail.with_unknown_zones(od), zones)),
        "quality_missing_zones": _on_both(lambda od, zones: quality.first_unmatched(retail.with_unknown_zones(od), zones)),
        "od_metadata": _on_both(lambda od, zones: quality.od_metadata(od)),
        "mode1_single_zone": _mode(ids=["3"], map_level="g33", counterpart_level="g250", day=None),
        "mode2_internal": _mode(**GROUP, mode=INTERNAL, include_self_loops=True),
        "mode3_group_external": _mode(**GROUP, mode=EXTERNAL),
        "mode4_combined": _mode(**GROUP, mode=COMBINED, include_self_loops=True, cap=20),
        "mode_destination_role": _mode(**GROUP, counterpart_level="g15", role="destination"),
        "breakdown_by_origin": _trips_by("internal", "origin_id"),
        "breakdown_by_dest": _trips_by("outgoing", "dest_id"),
        "breakdown_topn_others": _on_flows(lambda flows, zones: _outgoing_slices(flows, zones).select("id", "label", "trips", "n_zones")),
        "breakdown_overview": _on_flows(lambda flows, zones: breakdown.overview(flows, True).select("id", "label", "trips")),
        "breakdown_share": _on_flows(lambda flows, zones: breakdown.shares(_outgoing_slices(flows, zones)).select("id", "trips", "pct")),
        "breakdown_cumulative": _on_flows(_angles),
        "flow_totals": _on_flows(lambda flows, zones: breakdown.flow_totals(flows)),
        "zone_centroids": _on_zones(_zone_centroids),
        "zone_extent": _on_zones(lambda zones: dissolve.zone_extent(zones.base)),
        "zones_dissolved": _on_zones(_zones_dissolved),
        "dissolve_boundary": _on_zones(_boundary),
        "dissolved_polygons": _on_zones(_dissolved_polygons, retail.stored_levels),
        "zones_reproject": _on_zones(_zones_reproject),
        "zones_datum_shift": _on_zones(_zones_datum_shift),
        "zones_union": _on_zones(_zones_union),
        "zones_shapefile": _on_zones(_zones_shapefile),
        "zone_names_workbook": _on_zones(_zone_names_workbook),
        "zones_collection": _on_zones(_zones_collection),
        "flows_bucketed": lambda spark, sf_dir: flow_rollup(*retail.stored_buckets(spark, sf_dir), FlowQuery(level="g33", **MORNING)),
        "flows_from_sums": _from_sums(origin_level="g15", dest_level="g33", **MORNING),
        "flows_from_sums_ids": _from_sums(level="g33", origin_ids=PICKED, include_self_loops=True),
        "flows_zone_selection": _flows(level="taz", origin_ids=["3", "77", "120"], dest_ids=["1", "5", "12", "40", "99"]),
        "zones_geojson": _on_zones(_zones_geojson, retail.stored_levels),
        "zones_geojson_base": _on_zones(_zones_geojson_base),
        "flow_geometry": _on_flows(_flow_geometry, model=retail.stored_levels),
        "flow_display_round": _on_flows(_flow_display_round),
        "flow_geojson": _on_flows(_flow_geojson, model=retail.stored_levels),
        "flow_captions": _on_flows(_captions),
        "relevant_zones": _on_flows(_relevant_zones, Selection(**GROUP, mode=EXTERNAL), model=retail.stored_levels),
        "flows_labelled": _on_both(_flows_labelled),
        "export_flows": _on_flows(lambda flows, zones: export.flow_table(flows, zones, COMBINED_MORNING).drop("tag")),
        "export_summary": _on_flows(_export_summary, SUMMARY_SELECTION, with_flag=True),
        "export_summary_all_days": _on_flows(_export_summary_all_days, ALL_DAYS_SELECTION, with_flag=True),
        "export_breakdown": _on_flows(_export_breakdown),
        "breakdown_tabs_internal": _tabs(INTERNAL),
        "breakdown_tabs_external": _tabs(EXTERNAL),
        "breakdown_tabs_single": _tabs(SINGLE),
        "breakdown_tabs_destination": _tabs(SINGLE, role="destination"),
        "flow_arrows": _on_flows(_flow_arrows, model=retail.stored_levels),
        "zone_label_points": _on_flows(_zone_label_points, Selection(**GROUP, mode=EXTERNAL), model=retail.stored_levels),
        "sink_flows": _on_flows(_sink_flows),
        "sink_flow_export": _on_flows(_sink_flow_export),
        "sink_breakdown": _on_flows(_sink_breakdown),
        "sink_features": _on_zones(_sink_features),
        "filter_line": _on_flows(_filter_line),
        "zone_name_list": _on_zones(_zone_name_list),
        "zone_search_index": _on_zones(_zone_search_index),
        "zone_search": _on_zones(lambda zones: export.search_zones(zones, "taz", "00012", ["12"])),
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **(llm.oracle_sql() if llm else {})}
