"""Flow geometry and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.functions import flows as fx
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import resolve_level


def with_levels(flows: DataFrame, map_level: str, counterpart_level: str | None = None) -> DataFrame:
    """Add the level of each endpoint: outgoing flows end and incoming flows start at the counterpart level."""
    near, far = resolve_level(map_level), resolve_level(counterpart_level or map_level)
    tag = F.col("tag") if "tag" in flows.columns else F.lit("outgoing")
    return flows.withColumn("origin_level", F.when(tag == "incoming", far).otherwise(near)).withColumn(
        "dest_level", F.when(tag == "outgoing", far).otherwise(near)
    )


def label_flows(flows: DataFrame, zones: ZoneModel, map_level: str, counterpart_level: str | None = None) -> DataFrame:
    """Add `origin_label` and `dest_label`; a zone without a name is labelled with its id."""
    levels = [map_level, counterpart_level or map_level]
    out = with_levels(flows, map_level, counterpart_level)
    for side in ("origin", "dest"):
        names = zones.labels(levels).toDF(f"{side}_level", f"{side}_id", "__label")
        out = out.join(zones.hint(names), [f"{side}_level", f"{side}_id"], "left").withColumn(
            f"{side}_label", F.coalesce("__label", f"{side}_id")
        ).drop("__label")
    return out.drop("origin_level", "dest_level")


def flow_geometry(flows: DataFrame, zones: ZoneModel, map_level: str, counterpart_level: str | None = None) -> DataFrame:
    """Line, width, bearing and arrow point of each flow; flows without a centroid at either end drop out.

    Width is relative to the largest flow of the same tag, also counting flows that drop out.
    """
    tagged = flows if "tag" in flows.columns else flows.withColumn("tag", F.lit("outgoing"))
    largest = F.broadcast(tagged.groupBy("tag").agg(F.max("trips").alias("__largest")))  # one row per tag
    out = with_levels(tagged.join(largest, "tag"), map_level, counterpart_level)
    levels = [map_level, counterpart_level or map_level]
    for side in ("origin", "dest"):
        points = zones.points(levels).where("centroid_lon IS NOT NULL").select(
            F.col("level").alias(f"{side}_level"), F.col("id").alias(f"{side}_id"),
            F.coalesce("label", "id").alias(f"{side}_label"),
            F.col("centroid_lon").alias(f"{side}_lon"), F.col("centroid_lat").alias(f"{side}_lat"),
        )
        out = out.join(zones.hint(points), [f"{side}_level", f"{side}_id"])
    lon1, lat1, lon2, lat2 = (F.col(c) for c in ("origin_lon", "origin_lat", "dest_lon", "dest_lat"))
    return out.select(
        "tag", "origin_id", "dest_id", "origin_label", "dest_label", "trips",
        fx.width(F.col("trips"), F.col("__largest")).alias("width"),
        fx.bearing(lat1, lon1, lat2, lon2).alias("bearing"),
        lon1.alias("origin_lon"), lat1.alias("origin_lat"), lon2.alias("dest_lon"), lat2.alias("dest_lat"),
        fx.along(lon1, lon2).alias("arrow_lon"), fx.along(lat1, lat2).alias("arrow_lat"),
    )


def line_features(geometry: DataFrame) -> DataFrame:
    """`tag, origin_id, dest_id, feature`: a GeoJSON LineString feature per flow."""
    coordinates = F.array(F.array("origin_lon", "origin_lat"), F.array("dest_lon", "dest_lat"))
    properties = F.struct(
        "origin_id", "dest_id", "trips", "width", "bearing",
        F.col("origin_label").alias("orig_label"), F.col("dest_label").alias("dest_label"),
    )
    return geometry.select("tag", "origin_id", "dest_id", feature("LineString", coordinates, properties).alias("feature"))


def arrow_features(geometry: DataFrame) -> DataFrame:
    """`tag, origin_id, dest_id, feature`: a GeoJSON Point feature with the bearing of each flow."""
    point = F.array("arrow_lon", "arrow_lat")
    return geometry.select("tag", "origin_id", "dest_id", feature("Point", point, F.struct("bearing")).alias("feature"))


def feature(kind, coordinates, properties):
    kind = F.lit(kind) if isinstance(kind, str) else kind
    body = F.struct(kind.alias("type"), coordinates.alias("coordinates"))
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), body.alias("geometry"), properties.alias("properties")),
        {"ignoreNullFields": "false"},
    )


def captions(labelled: DataFrame) -> DataFrame:
    text = fx.caption(F.col("origin_label"), F.col("dest_label"), F.col("trips"))
    return labelled.withColumn("caption", text)


def relevant_zones(
    flows: DataFrame, zones: ZoneModel, selected_ids, map_level: str, counterpart_level: str | None = None
) -> DataFrame:
    """Label points of zones that are selected or an endpoint of a flow: `level, id, label, centroid_lon, centroid_lat`."""
    near, far = resolve_level(map_level), resolve_level(counterpart_level or map_level)
    placed = with_levels(flows, near, far)
    ends = placed.select(F.explode(F.array(
        F.struct(F.col("origin_level").alias("level"), F.col("origin_id").alias("id")),
        F.struct(F.col("dest_level").alias("level"), F.col("dest_id").alias("id")),
    )).alias("e")).select("e.*")
    points = zones.points([near, far])
    chosen = (F.col("level") == near) & F.col("id").isin(list(selected_ids))
    wanted = ends.union(points.where(chosen).select("level", "id"))
    return points.join(wanted, ["level", "id"], "left_semi").select(
        "level", "id", F.coalesce("label", "id").alias("label"), "centroid_lon", "centroid_lat"
    )


def label_points(relevant: DataFrame) -> DataFrame:
    """`id, feature`: a GeoJSON Point feature with the label of each relevant zone."""
    point = F.array("centroid_lon", "centroid_lat")
    return relevant.select("id", feature("Point", point, F.struct("label")).alias("feature"))
