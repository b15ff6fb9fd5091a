"""Zone tables of a level: labels, centroids, extents and dissolved outlines of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.functions import geometry as geo
from zoneflow.functions.scale import ensure_checkpoint_dir
from zoneflow.operators.noding import SNAP, cell_index, noded
from zoneflow.params import BASE_LEVEL, LEVEL_LABEL, resolve_level

# Decimals to which vertices snap before shared sides are matched.
SNAP_DECIMALS = 9


def with_centroids(zones: DataFrame) -> DataFrame:
    """Add the planar centroid of each zone, in degrees, and its area."""
    moment, center = F.col("__m"), geo.centroid(F.col("__m"))
    return zones.withColumn("__m", geo.moments(F.col("geometry"))).withColumns({
        "centroid_lat": center.lat, "centroid_lon": center.lon, "area": moment.area,
    }).drop("__m")


def zone_tables(base: DataFrame, levels: Sequence[str]) -> DataFrame:
    """`level, id, label, centroid_lon, centroid_lat, n_zones, area`, one row per zone or group of the given levels.

    The centroid of a group is that of the union of its zones: as zones do not overlap, areas and area-weighted centroids
    add up, so a group of any size is summed in parts. All levels come from one pass. Zones without a parent drop out.
    """
    measured = base if "area" in base.columns else with_centroids(base)
    entries = F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(level).alias("id"), F.col(LEVEL_LABEL[level]).alias("label"))
        for level in dict.fromkeys(resolve_level(level) for level in levels)
    ])
    rows = measured.select(F.inline(entries), "centroid_lon", "centroid_lat", "area").where("id IS NOT NULL")
    weight = F.when(F.sum("area") != 0, F.sum("area"))
    return rows.groupBy("level", "id").agg(
        F.min("label").alias("label"),
        *[(F.sum(F.col("area") * F.col(axis)) / weight).alias(axis) for axis in ("centroid_lon", "centroid_lat")],
        F.count("*").alias("n_zones"), F.sum("area").alias("area"),
    )


def zone_table(base: DataFrame, level: str) -> DataFrame:
    """`zone_tables` of one level, without the level column. At the base level no rows move."""
    level = resolve_level(level)
    if level != BASE_LEVEL:
        return zone_tables(base, [level]).drop("level")
    measured = base if "area" in base.columns else with_centroids(base)
    return measured.select(
        F.col(BASE_LEVEL).alias("id"), F.col("zone_name").alias("label"), "centroid_lon", "centroid_lat",
        F.lit(1).cast("bigint").alias("n_zones"), "area",
    )


def zone_extent(base: DataFrame) -> DataFrame:
    """One row with the smallest and largest coordinates of all zones."""
    boxes = base.select(geo.bounds(F.col("geometry")).alias("box")).select("box.*")
    return boxes.agg(
        F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"),
    )


def group_sides(base: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Sides and pieces of sides of the zones of each group: `level, group_id, x1, y1, x2, y2, n, part, other_part, left, right`.

    (x1, y1) is the smaller end; `left` and `right` tell whether a zone of the group lies there, seen from it to (x2, y2). `n` counts
    the zones that share the side. A part is one polygon of a zone. Zones may overlap and need not share vertices: sides are cut
    where others meet or cross them. Rows without ends only tell that two parts overlap.
    """
    columns = list(dict.fromkeys(resolve_level(level) for level in levels))
    tagged = F.transform("geometry", lambda polygon, at: F.struct(F.transform(polygon, _snap).alias("polygon"), at.alias("at")))
    parts = base.select(*columns, F.col(BASE_LEVEL).alias("zone"), F.inline(tagged))
    parts = parts.select(*columns, F.concat_ws("/", "zone", "at").alias("part"), "polygon")
    rings = parts.select(*columns, "part", F.posexplode("polygon").alias("position", "ring"))
    keep = (geo.doubled_area(F.col("ring")) > 0) == (F.col("position") == 0)
    turned = rings.select(*columns, "part", F.when(keep, F.col("ring")).otherwise(F.reverse("ring")).alias("ring"))
    sides = turned.select(*columns, "part", F.inline(geo.ring_sides(F.col("ring")))).where("x1 <> x2 OR y1 <> y2")
    grouped = sides.unpivot(["part", *ENDS], columns, "level", "group_id").where("group_id IS NOT NULL")
    ensure_checkpoint_dir(base.sparkSession)
    matched = _matched(grouped).checkpoint()
    inner, open_ = matched.where("inner"), matched.where("not inner and n_forward * 2 <> n")
    pieces, broken = noded(open_.select("level", "group_id", "part", *_directed("n_forward * 2 > n")))
    pieces = _matched(pieces).where("inner or n_forward * 2 <> n").checkpoint()
    covered = _covered(pieces.where("not inner"), parts, columns, broken)
    both = inner.unionByName(pieces.where("inner")).select(*_KEYS, "n", "part", "other_part", F.lit(True).alias("left"), F.lit(True).alias("right"))
    return both.unionByName(covered)


ENDS = ["x1", "y1", "x2", "y2"]
_KEYS = ["level", "group_id", *ENDS]


def _directed(forward: str) -> list[Column]:
    """Ends of an undirected side, swapped unless `forward` holds."""
    opposite = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return [F.when(F.expr(forward), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in opposite.items()]


def _matched(directed: DataFrame) -> DataFrame:
    """Directed sides brought together with their equals in the group, whatever their direction.

    A side that two parts walk in opposite directions is `inner`. One that has as many walks of either direction and is not inner
    bounds nothing.
    """
    forward = F.struct("x1", "y1") < F.struct("x2", "y2")
    ends = [
        F.when(forward, F.col(f"{axis}{a}")).otherwise(F.col(f"{axis}{b}")).alias(f"{axis}{a}")
        for a, b in ((1, 2), (2, 1)) for axis in ("x", "y")
    ]
    part = {way: F.when(F.col("forward") == (way == "forward"), F.col("part")) for way in ("forward", "back")}
    found = directed.select("level", "group_id", "part", forward.alias("forward"), *ends).groupBy(*_KEYS).agg(
        F.count("*").alias("n"), F.count_if("forward").alias("n_forward"), F.min("part").alias("part"), F.max("part").alias("other_part"),
        *[pick(part[way]).alias(f"{name}_{way}") for way in part for name, pick in (("low", F.min), ("high", F.max))],
    )
    inner = F.coalesce((F.col("low_forward") != F.col("low_back")) | (F.col("high_forward") != F.col("high_back")), F.lit(False))
    return found.select(*_KEYS, "n", "n_forward", "part", "other_part", inner.alias("inner"))


def _covered(pieces: DataFrame, parts: DataFrame, columns: Sequence[str], broken: DataFrame) -> DataFrame:
    """`left` and `right` of pieces that are not inner, and a row without ends for every two parts that overlap.

    A part lies to the left of its own side. On either side there may be others: those around the middle of the piece, found by
    boxes in a grid, are asked by the parity of the sides that a ray from there crosses. Parts that cross themselves are asked, too.
    """
    middle = {axis: (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2 for axis in ("x", "y")}
    upright = F.abs(F.col("y2") - F.col("y1")) >= F.col("x2") - F.col("x1")
    placed = pieces.withColumns({
        "piece": F.monotonically_increasing_id(), "mx": middle["x"], "my": middle["y"], "upright": upright,
        "ray_left": ~upright | (F.col("y2") < F.col("y1")),
    }).checkpoint()

    boxes = parts.select(*columns, "part", geo.bounds(F.array("polygon")).alias("box")).select(*columns, "part", "box.*")
    boxes = boxes.unpivot(["part", "min_lon", "min_lat", "max_lon", "max_lat"], columns, "level", "group_id").where("group_id IS NOT NULL")
    wide = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"), F.lit(SNAP))
    boxes = boxes.withColumn("grid", F.ceil(F.log2(wide)).cast("int")).checkpoint()
    grids = sorted(row["grid"] for row in boxes.select("grid").distinct().collect())  # powers of two between the least and the largest box
    if not grids:
        return placed.select(*_KEYS, "n", "part", "other_part", F.lit(True).alias("left"), F.lit(False).alias("right"))
    cell = F.pow(F.lit(2.0), F.col("grid"))
    at = lambda value: cell_index(value, cell)
    low, high = {"cx": "min_lon", "cy": "min_lat"}, {"cx": "max_lon", "cy": "max_lat"}
    held = boxes.withColumnRenamed("part", "around")
    for name in ("cx", "cy"):
        held = held.withColumn(name, F.explode(F.sequence(at(F.col(low[name]) - SNAP), at(F.col(high[name]) + SNAP))))
    asked = placed.withColumn("grid", F.explode(F.array(*[F.lit(g) for g in grids]))).withColumns({"cx": at(F.col("mx")), "cy": at(F.col("my"))})
    met = asked.join(held, ["level", "group_id", "grid", "cx", "cy"]).where(
        F.col("mx").between(F.col("min_lon") - SNAP, F.col("max_lon") + SNAP) & F.col("my").between(F.col("min_lat") - SNAP, F.col("max_lat") + SNAP)
    )
    whole = broken.withColumn("whole", F.lit(False))
    met = met.join(whole.withColumnRenamed("part", "around"), ["level", "group_id", "around"], "left")
    met = met.where((F.col("around") != F.col("part")) | F.col("whole").isNotNull())
    rings = parts.select(F.col("part").alias("around"), "polygon")
    counted = met.join(rings, "around").withColumn("c", _crossed(F.col("polygon")))
    counted = counted.select("piece", "level", "group_id", "part", "around", "ray_left", (F.col("c.beyond") % 2 == 1).alias("ray"), ((F.col("c.beyond") + F.col("c.at")) % 2 == 1).alias("back"))
    inside = counted.where("ray or back").checkpoint()

    others = inside.groupBy("piece").agg(
        F.max(F.when(F.col("ray_left"), F.col("ray")).otherwise(F.col("back"))).alias("other_left"),
        F.max(F.when(F.col("ray_left"), F.col("back")).otherwise(F.col("ray"))).alias("other_right"),
    )
    own = placed.join(whole, ["level", "group_id", "part"], "left").withColumn("forward", F.col("n_forward") * 2 > F.col("n")).join(others, "piece", "left")
    trusted = F.col("whole").isNull()
    known = own.select(
        *_KEYS, "n", "part", "other_part",
        (F.coalesce("other_left", F.lit(False)) | (trusted & F.col("forward"))).alias("left"),
        (F.coalesce("other_right", F.lit(False)) | (trusted & ~F.col("forward"))).alias("right"),
    )
    links = inside.where("part <> around").select("level", "group_id", "part", F.col("around").alias("other_part")).distinct()
    nowhere = [F.lit(None).cast("double").alias(end) for end in ENDS]
    return known.unionByName(links.select(
        "level", "group_id", *nowhere, F.lit(2).cast("bigint").alias("n"), "part", "other_part", F.lit(True).alias("left"), F.lit(True).alias("right")
    ))


def _crossed(polygon: Column) -> Column:
    """struct<beyond, at>: sides of a polygon that the ray from (mx, my) crosses, to the right of an upright piece and upwards from
    others, and sides that the point lies on."""
    mx, my, upright = F.col("mx"), F.col("my"), F.col("upright")

    def step(acc: Column, s: Column) -> Column:
        dx, dy = s.x2 - s.x1, s.y2 - s.y1
        length = F.sqrt(dx * dx + dy * dy)
        beside = F.abs((mx - s.x1) * dy - (my - s.y1) * dx)
        along = (mx - s.x1) * dx + (my - s.y1) * dy
        on = (beside <= SNAP * length) & (along >= 0) & (along <= length * length)
        right = ((s.y1 > my) != (s.y2 > my)) & (s.x1 + (my - s.y1) / F.nullif(dy, F.lit(0.0)) * dx > mx)
        above = ((s.x1 > mx) != (s.x2 > mx)) & (s.y1 + (mx - s.x1) / F.nullif(dx, F.lit(0.0)) * dy > my)
        hit = ~on & F.coalesce(F.when(upright, right).otherwise(above), F.lit(False))
        return F.struct((acc.beyond + hit.cast("int")).alias("beyond"), (acc["at"] + on.cast("int")).alias("at"))

    sides = F.flatten(F.transform(polygon, geo.ring_sides))
    return F.aggregate(sides, F.struct(F.lit(0).alias("beyond"), F.lit(0).alias("at")), step)


def _snap(ring):
    return F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, SNAP_DECIMALS)))


def boundary_edges(sides: DataFrame) -> DataFrame:
    """Directed outline of every group: `level, group_id, part, x1, y1, x2, y2`, the group to the left of each side."""
    return sides.where("left <> right").select("level", "group_id", "part", *_directed("left"))


def boundary_lengths(edges: DataFrame) -> DataFrame:
    """`level, group_id, n_edges, perimeter` (degrees) of directed outline sides."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return edges.groupBy("level", "group_id").agg(F.count("*").alias("n_edges"), F.sum(length).alias("perimeter"))
