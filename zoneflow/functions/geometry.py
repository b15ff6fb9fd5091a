"""Planar geometry on nested arrays: multipolygon -> polygon -> ring -> [lon, lat]. Rings are closed; holes follow the shell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY_TYPE = "array<array<array<array<double>>>>"

_WEB_MERCATOR_RADIUS = 6378137.0


def rings(geometry: Column) -> Column:
    return F.flatten(geometry)


def vertices(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat> over all vertices of a row."""
    lons = F.transform(vertices(geometry), lambda p: p[0])
    lats = F.transform(vertices(geometry), lambda p: p[1])
    return F.struct(
        F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"),
        F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"),
    )


def ring_sides(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring."""
    return F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
    )


def doubled_area(ring: Column) -> Column:
    """Twice the signed area of a ring, positive if it runs counter-clockwise."""
    x0, y0 = ring[0][0], ring[0][1]
    return F.aggregate(
        ring_sides(ring), F.lit(0.0), lambda acc, s: acc + (s.x1 - x0) * (s.y2 - y0) - (s.x2 - x0) * (s.y1 - y0)
    )


def _ring_moments(ring: Column, position: Column) -> Column:
    """Area and first moments of one ring, positive for a shell and negative for a hole whatever its winding.

    Vertices are taken relative to the first one, which keeps the products small and exact on grid squares.
    """
    x0, y0 = ring[0][0], ring[0][1]
    products = F.transform(ring_sides(ring), lambda s: F.struct(
        ((s.x1 - x0) * (s.y2 - y0) - (s.x2 - x0) * (s.y1 - y0)).alias("cross"),
        (s.x1 + s.x2 - 2 * x0).alias("x"), (s.y1 + s.y2 - 2 * y0).alias("y"),
    ))
    sign = F.when(position == 0, 1.0).otherwise(-1.0)
    return F.aggregate(
        products,
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, s: F.struct(
            (acc.a + s.cross).alias("a"), (acc.x + s.cross * s.x).alias("x"), (acc.y + s.cross * s.y).alias("y")
        ),
        lambda acc: F.struct(
            (sign * F.abs(acc.a) / 2).alias("area"),
            (sign * F.signum(acc.a) * (acc.a / 2 * x0 + acc.x / 6)).alias("mx"),
            (sign * F.signum(acc.a) * (acc.a / 2 * y0 + acc.y / 6)).alias("my"),
        ),
    )


def moments(geometry: Column) -> Column:
    """struct<area, mx, my> of a multipolygon. The centroid is (mx / area, my / area); moments of disjoint parts add up."""
    parts = F.flatten(F.transform(geometry, lambda polygon: F.transform(polygon, _ring_moments)))
    return F.aggregate(
        parts,
        F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")),
        lambda acc, p: F.struct(*[(acc[name] + p[name]).alias(name) for name in ("area", "mx", "my")]),
    )


def centroid(moment: Column) -> Column:
    """struct<lon, lat> of a moments struct; null for a geometry without area."""
    area = F.when(moment.area != 0, moment.area)
    return F.struct((moment.mx / area).alias("lon"), (moment.my / area).alias("lat"))


@dataclass(frozen=True)
class Helmert:
    """Seven parameters to WGS84 as a position vector transformation: metres, seconds of arc, parts per million."""

    x: float
    y: float
    z: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


@dataclass(frozen=True)
class TransverseMercator:
    """Projection parameters: ellipsoid (a, inverse flattening), origin in degrees, scale and false origin in metres, and the shift
    of its datum to WGS84."""

    semi_major: float
    inverse_flattening: float
    lat_0: float
    lon_0: float
    scale: float
    false_easting: float
    false_northing: float
    shift: Helmert | None = None


# Ellipsoid of WGS84.
WGS84 = (6378137.0, 298.257223563)
# Projection parameters of the Israeli grid on the GRS80 ellipsoid, and the published shift of its datum.
_ITM = TransverseMercator(
    6378137.0, 298.257222101, 31.7343936111111, 35.2045169444444, 1.0000067, 219529.584, 626907.39,
    Helmert(-24.0024, -17.1032, -17.8444, -0.33077, -1.85269, 1.66969, 5.4248),
)


def source_crs(epsg: int) -> TransverseMercator | int:
    """Supported source systems: 4326, 3857, the national grid 2039, UTM on WGS84 (326zz north, 327zz south)."""
    zone = epsg % 100
    if epsg in (4326, 3857):
        return epsg
    if epsg == 2039:
        return _ITM
    if epsg // 100 in (326, 327) and 1 <= zone <= 60:
        north = 0.0 if epsg // 100 == 326 else 10_000_000.0
        return TransverseMercator(6378137.0, 298.257223563, 0.0, 6.0 * zone - 183.0, 0.9996, 500_000.0, north)
    raise ValueError(f"unsupported source EPSG:{epsg}")


def to_degrees(geometry: Column, crs: int | TransverseMercator) -> Column:
    """Reproject every vertex to longitude and latitude in degrees on WGS84, with the datum shift of the source if it has one."""
    crs = source_crs(crs) if isinstance(crs, int) else crs
    if crs == 4326:
        return geometry
    invert = _from_web_mercator if crs == 3857 else _transverse_inverse(crs)
    shift = None if crs == 3857 else crs.shift

    def ring_to_degrees(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.array(*invert(p[0], p[1])))
        return points if shift is None else shifted(points, (crs.semi_major, crs.inverse_flattening), shift)

    return F.transform(geometry, lambda polygon: F.transform(polygon, ring_to_degrees))


def shifted(points: Column, ellipsoid: tuple[float, float], shift: Helmert, target: tuple[float, float] = WGS84) -> Column:
    """An array of [lon, lat] on one datum as the same on another: over geocentric coordinates, at height 0.

    Each step is a transform of its own, so that what several terms need is computed once a vertex.
    """
    return F.transform(
        F.transform(F.transform(points, lambda p: to_geocentric(p[0], p[1], ellipsoid)), lambda v: helmert(v, shift)),
        lambda v: F.array(*to_geodetic(v, target)),
    )


def _eccentricity(ellipsoid: tuple[float, float]) -> float:
    """Square of the first eccentricity."""
    f = 1 / ellipsoid[1]
    return f * (2 - f)


def to_geocentric(lon: Column, lat: Column, ellipsoid: tuple[float, float], height: float = 0.0) -> Column:
    """struct<x, y, z> in metres of a point given in degrees."""
    e2, sine = _eccentricity(ellipsoid), F.sin(F.radians(lat))
    normal = ellipsoid[0] / F.sqrt(1 - e2 * sine * sine)
    flat = (normal + height) * F.cos(F.radians(lat))
    return F.struct((flat * F.cos(F.radians(lon))).alias("x"), (flat * F.sin(F.radians(lon))).alias("y"), ((normal * (1 - e2) + height) * sine).alias("z"))


def helmert(v: Column, shift: Helmert) -> Column:
    """struct<x, y, z> after rotation by small angles, scaling and translation."""
    scale = 1 + shift.ppm * 1e-6
    rx, ry, rz = (math.radians(seconds / 3600) for seconds in (shift.rx, shift.ry, shift.rz))
    return F.struct(
        (shift.x + scale * (v["x"] - rz * v["y"] + ry * v["z"])).alias("x"),
        (shift.y + scale * (rz * v["x"] + v["y"] - rx * v["z"])).alias("y"),
        (shift.z + scale * (-ry * v["x"] + rx * v["y"] + v["z"])).alias("z"),
    )


def to_geodetic(v: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a geocentric point, by Bowring's formula (exact to less than a millimetre near the ground)."""
    a, e2 = ellipsoid[0], _eccentricity(ellipsoid)
    b = a * math.sqrt(1 - e2)
    flat = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
    reduced = F.atan2(v["z"] * a, flat * b)
    second = e2 / (1 - e2)
    lat = F.atan2(v["z"] + second * b * F.pow(F.sin(reduced), 3), flat - e2 * a * F.pow(F.cos(reduced), 3))
    return F.degrees(F.atan2(v["y"], v["x"])), F.degrees(lat)


def _from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lat = 2 * F.atan(F.exp(y / _WEB_MERCATOR_RADIUS)) - math.pi / 2
    return F.degrees(x / _WEB_MERCATOR_RADIUS), F.degrees(lat)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    y = F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4))
    return F.radians(lon) * _WEB_MERCATOR_RADIUS, y * _WEB_MERCATOR_RADIUS


def _transverse_inverse(crs: TransverseMercator):
    """Inverse transverse Mercator by the published series in the third flattening n (to n^4)."""
    f = 1 / crs.inverse_flattening
    n = f / (2 - f)
    radius = crs.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    to_latitude = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    # northing of the origin on the rectifying sphere
    phi = math.radians(crs.lat_0)
    ecc = 2 * math.sqrt(n) / (1 + n)
    conformal = math.atan(math.sinh(math.atanh(math.sin(phi)) - ecc * math.atanh(ecc * math.sin(phi))))
    origin = conformal + sum(a * math.sin(2 * j * conformal) for j, a in enumerate(forward, 1))

    def invert(x: Column, y: Column) -> tuple[Column, Column]:
        xi = (y - crs.false_northing) / (crs.scale * radius) + origin
        eta = (x - crs.false_easting) / (crs.scale * radius)
        xi0, eta0 = xi, eta
        for j, b in enumerate(inverse, 1):
            xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(xi0) / F.cosh(eta0))
        lat = chi
        for j, d in enumerate(to_latitude, 1):
            lat = lat + d * F.sin(2 * j * chi)
        return crs.lon_0 + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(lat)

    return invert
