from __future__ import annotations

import dataclasses
import math

import pytest
from helpers import as_set, box, model, ring, zone
from pyspark.sql import functions as F

from zoneflow.functions import flows as fx
from zoneflow.functions import geometry as geo
from zoneflow.functions.scale import sequential_index
from zoneflow.operators import dissolve, outline, zonemap

GEO = f"g {geo.GEOMETRY_TYPE}"


def shapes(spark, *geometries):
    return spark.createDataFrame([(g,) for g in geometries], GEO)


def centers(df):
    return [tuple(r[0]) for r in df.select(geo.centroid(geo.moments(F.col("g")))).collect()]


def test_centroid_of_holes_parts_and_either_winding(spark):
    donut = [[box(0, 0, 4, 4), box(2, 2)]]
    turned = [[list(reversed(r)) for r in donut[0]]]
    mixed = [[donut[0][0], list(reversed(donut[0][1]))]]
    expected = ((4 * 4 * 2 - 2.5) / 15,) * 2
    for got in centers(shapes(spark, donut, turned, mixed)):
        assert got == pytest.approx(expected)
    parts, triangle = [[box(0, 0)], [box(3, 0, 2, 2)]], [[ring((0, 0), (3, 0), (0, 3))]]
    assert centers(shapes(spark, parts, triangle)) == [pytest.approx(((0.5 + 16) / 5, 0.9)), pytest.approx((1, 1))]
    assert centers(shapes(spark, [[ring((0, 0), (1, 1))]])) == [(None, None)]


def test_bounds_over_all_parts(spark):
    df = shapes(spark, [[box(0, 0)], [box(-3, 5, 1, 2)]])
    assert tuple(df.select(geo.bounds(F.col("g"))).first()[0]) == (-3, 0, 1, 7)


def project(spark, crs, *points):
    df = shapes(spark, [[[list(p) for p in points]]])
    return df.select(geo.to_degrees(F.col("g"), crs)[0][0]).first()[0]


def test_web_mercator(spark):
    half = 20037508.342789244
    corners = project(spark, 3857, (0.0, 0.0), (half, half), (-half / 2, 0.0))
    for got, want in zip(corners, ((0, 0), (180, 85.0511287798066), (-90, 0))):
        assert got == pytest.approx(want, abs=1e-9)


def forward_utm(lon, lat, lon0):
    """Truncated series in powers of the longitude difference, as an independent check."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, n = math.radians(lat), a / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
    t, c, s = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, math.radians(lon - lon0) * math.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
             + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
    x = k0 * n * (s + (1 - t + c) * s**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * s**5 / 120)
    y = k0 * (m + n * math.tan(phi) * (s**2 / 2 + (5 - t + 9 * c + 4 * c**2) * s**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * s**6 / 720))
    return x + 500000.0, y


def test_transverse_mercator(spark):
    places = [(34.8, 32.1), (33.0, 0.0), (35.9, 29.5), (30.2, 60.0)]
    got = project(spark, 32636, *[forward_utm(lon, lat, 33.0) for lon, lat in places])
    for have, want in zip(got, places):
        assert have == pytest.approx(want, abs=1e-7)
    south = project(spark, 32736, (500000.0, 10_000_000.0))
    assert south[0] == pytest.approx((33.0, 0.0), abs=1e-9)
    plain = dataclasses.replace(geo.source_crs(2039), shift=None)
    origin = project(spark, plain, (219529.584, 626907.39))
    assert origin[0] == pytest.approx((35.2045169444444, 31.7343936111111), abs=1e-9)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_geocentric_and_position_vector_examples(spark):
    """The worked examples of the EPSG guidance on coordinate conversions (note 7-2)."""
    lon, lat = F.lit(2 + 7 / 60 + 46.38 / 3600), F.lit(53 + 48 / 60 + 33.82 / 3600)
    assert tuple(one(spark, geo.to_geocentric(lon, lat, geo.WGS84, 73.0))) == pytest.approx((3771793.968, 140253.342, 5124304.349), abs=2e-3)
    v = F.struct(*[F.lit(x).alias(n) for n, x in zip("xyz", (3657660.66, 255768.55, 5201382.11))])
    moved = one(spark, geo.helmert(v, geo.Helmert(0, 0, 4.5, 0, 0, 0.554, 0.219)))
    assert tuple(moved) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=6e-3)
    back = F.array(*geo.to_geodetic(geo.to_geocentric(lon, lat, geo.WGS84), geo.WGS84))
    assert one(spark, back) == pytest.approx((2 + 7 / 60 + 46.38 / 3600, 53 + 48 / 60 + 33.82 / 3600), abs=1e-11)


def test_national_grid_is_shifted_to_wgs84(spark):
    """Tens of metres, close to what the older published set of three translations gives."""
    places = [(219529.584, 626907.39), (180000.0, 665000.0), (200000.0, 390000.0), (250000.0, 790000.0)]
    crs = geo.source_crs(2039)
    full, plain = project(spark, crs, *places), project(spark, dataclasses.replace(crs, shift=None), *places)
    older = project(spark, dataclasses.replace(crs, shift=geo.Helmert(-48.0, 55.0, 52.0)), *places)

    def metres(a, b):
        return math.hypot((a[0] - b[0]) * math.cos(math.radians(b[1])), a[1] - b[1]) * math.radians(6371000)

    assert all(40 < metres(a, b) < 100 for a, b in zip(full, plain))
    assert all(metres(a, b) < 15 for a, b in zip(full, older))
    assert project(spark, 2039, *places) == full


def test_other_systems_are_rejected(spark):
    for epsg in (27700, 32661, 4269):
        with pytest.raises(ValueError):
            geo.source_crs(epsg)
    assert project(spark, 4326, (1.0, 2.0)) == [[1.0, 2.0]]


def dissolved(spark, *geometries):
    zones = model(spark, [zone(str(i), "A", geometry=g) for i, g in enumerate(geometries)])
    shapes = outline.dissolved_geometry(outline.dissolved_polygons(zones.base, ["g33"]))
    return shapes.first()["geometry"]


def cells(text):
    rows = text.split()
    return [[[box(x, len(rows) - y)]] for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"]


def area(polygons):
    def ring_area(r):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2

    assert all(ring_area(p[0]) > 0 and all(ring_area(h) < 0 for h in p[1:]) for p in polygons)
    assert all(r[0] == r[-1] and len({tuple(v) for v in r}) == len(r) - 1 for p in polygons for r in p)
    return sum(ring_area(r) for p in polygons for r in p)


GRIDS = [
    ("##", 1, 0),
    ("#. .#", 2, 0),  # touch at a vertex
    ("### #.# ###", 1, 1),  # ring around a gap
    (".#. #.# .#.", 4, 0),  # four cells around a gap, only touching at vertices
    ("#### #.## ##.# ####", 1, 2),  # two gaps that touch at a vertex
    ("####. #..#. ####. .....", 1, 1),
    ("##### #...# #.#.# #...# #####", 2, 1),  # an island inside a gap
    ("### #.# ##.", 1, 1),  # the gap touches the outside at a vertex
    ("######### #.#.#.#.# ######### #.......# #.#####.# #.#...#.# #.#.#.#.# #.#...#.# #.#####.# #.......# #########", 3, 6),
]


@pytest.fixture(scope="module")
def grid_shapes(spark):
    zones = [zone(f"{i}-{j}", f"grid{i}", geometry=g) for i, (text, *_) in enumerate(GRIDS) for j, g in enumerate(cells(text))]
    shapes = outline.dissolved_geometry(outline.dissolved_polygons(model(spark, zones).base, ["g33"]))
    return {r["group_id"]: r["geometry"] for r in shapes.collect()}


@pytest.mark.parametrize("i", range(len(GRIDS)))
def test_dissolved_shapes(grid_shapes, i):
    text, polygons, holes = GRIDS[i]
    got = grid_shapes[f"grid{i}"]
    assert len(got) == polygons and sum(len(p) - 1 for p in got) == holes
    assert area(got) == pytest.approx(text.count("#"))


def test_dissolve_keeps_zone_holes_and_fills_them(spark):
    donut = [[box(0, 0, 3, 3), box(1, 1)]]
    assert sum(len(p) - 1 for p in dissolved(spark, donut)) == 1
    assert dissolved(spark, donut, [[box(1, 1)]]) == [[box(0, 0, 3, 3)]]
    apart = dissolved(spark, [[box(0, 0)], [box(5, 5)]], [[box(1, 0)]])
    assert len(apart) == 2 and area(apart) == 3


def test_long_ring(spark):
    """A comb: one ring of many sides takes many doubling rounds."""
    comb = [[[box(x, y)]] for x in range(0, 60, 2) for y in range(3)] + [[[box(x, 0)]] for x in range(1, 60, 2)]
    got = dissolved(spark, *comb)
    assert len(got) == 1 and len(got[0]) == 1 and area(got) == len(comb)


def test_boundary_and_group_centroid(spark):
    zones = model(spark, [zone("1", "A", geometry=[[box(0, 0)]]), zone("2", "A", geometry=[[box(1, 0)]]),
                          zone("3", None, geometry=[[box(9, 9)]]), zone("4", "B", geometry=[[box(5, 0, 3, 3)]])])
    edges = dissolve.boundary_edges(dissolve.group_sides(zones.base, ["g33"]))
    assert as_set(dissolve.boundary_lengths(edges)) == {("g33", "A", 6, 6.0), ("g33", "B", 4, 12.0)}
    table = dissolve.zone_table(zones.base, "g33").orderBy("id").collect()
    assert [(r["id"], r["centroid_lon"], r["n_zones"], r["area"]) for r in table] == [("A", 1.0, 2, 2.0), ("B", 6.5, 1, 9.0)]


@pytest.mark.parametrize("a, b, want", [((0, 0), (0, 1), 90), ((0, 0), (1, 0), 0), ((0, 0), (-1, 0), 180), ((0, 0), (0, -1), 270),
                                        ((32.08, 34.78), (31.77, 35.21), 130.2)])
def test_bearing(spark, a, b, want):
    got = spark.range(1).select(fx.bearing(*[F.lit(float(v)) for v in (*a, *b)])).first()[0]
    assert got == pytest.approx(want, abs=0.1)


def test_width_and_counts(spark):
    w = lambda t, m: fx.width(F.lit(float(t)), F.lit(float(m)))
    assert tuple(spark.range(1).select(w(0, 0), w(9, 9), w(0, 9)).first()) == (2.0, 14.0, 2.0)
    counts = [fx.rounded_count(F.lit(v)) for v in (9994.9, 9995.0, 10000.0, 10050.0, 4.9, 5.0)] + [fx.plain_count(F.lit(2.5))]
    assert tuple(spark.range(1).select(*counts).first()) == (9990, 10000, 10000, 10100, 0, 10, 3)


def test_labels_of_day_and_time(spark):
    row = spark.range(1).select(
        fx.day_label(F.lit("friday")), fx.day_label(F.lit("x")), fx.time_label(F.lit(0), F.lit(24)), fx.time_label(F.lit(7), F.lit(10)),
    ).first()
    assert tuple(row) == ("יום שישי", "x", 'סה"כ יומי', "‪7–10‬")


def test_index_follows_the_key(spark):
    df = spark.range(5000).select(F.concat(F.lit("z"), F.col("id") * 7919 % 5003).alias("id"))
    many = sequential_index(df, "id")
    ordered = sorted(r.id for r in df.collect())
    assert dict(many.dtypes)["idx"] == "bigint" and as_set(many) == {(key, i) for i, key in enumerate(ordered)}


def test_features(spark):
    zones = model(spark, [zone("b", "B", geometry=[[box(0, 0)], [box(5, 5)]]), zone("a", "A")])
    rows = dissolve.zone_table(zones.base, "taz").join(zones.base.select(F.col("taz").alias("id"), "geometry"), "id")
    rows = rows.select("id", "label", "centroid_lat", "centroid_lon", "geometry")
    got = [tuple(r) for r in zonemap.zone_features(rows).orderBy("idx").collect()]
    assert [r[:3] for r in got] == [(0, "a", None), (1, "b", None)]
    assert got[0][3] == (
        '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,1.0],[0.0,0.0]]]},'
        '"properties":{"id":"a","label":null,"centroid_lat":0.5,"centroid_lon":0.5,"idx":0}}')
    assert '"type":"MultiPolygon"' in got[1][3]
