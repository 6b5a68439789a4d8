"""Geometry as arrays of points: transforms, lengths, validity, map projections.

Map projections are the Transverse Mercator series of the WGS 84 ellipsoid for UTM zones (EPSG 326xx
and 327xx), and those of SYSTEMS: web Mercator and conics. Others are rejected. Datums are taken as one:
those of the systems here differ from WGS 84 by less than a metre or two, and are not shifted.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 and UTM (fixed values).
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def pixel_to_world(c: Column, r: Column, a="t_a", b="t_b", tx="t_c", d="t_d", e="t_e", ty="t_f") -> tuple[Column, Column]:
    """World position of a pixel's centre by its scene's affine transform."""
    x, y = c + F.lit(0.5), r + F.lit(0.5)
    return F.col(a) * x + F.col(b) * y + F.col(tx), F.col(d) * x + F.col(e) * y + F.col(ty)


def bounds() -> dict[str, Column]:
    """West, south, east and north of a scene with width, height and transform columns."""
    corners = [(F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.lit(0), F.col("height")), (F.col("width"), F.col("height"))]
    xs = [F.col("t_a") * x + F.col("t_b") * y + F.col("t_c") for x, y in corners]
    ys = [F.col("t_d") * x + F.col("t_e") * y + F.col("t_f") for x, y in corners]
    return {"west": F.least(*xs), "south": F.least(*ys), "east": F.greatest(*xs), "north": F.greatest(*ys)}


def line_length(geom: Column) -> Column:
    """Length of a line of points (x, y)."""
    n = F.size(geom)
    pairs = F.zip_with(F.slice(geom, 1, F.greatest(n - 1, F.lit(0))), F.slice(geom, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def is_line(geom: Column) -> Column:
    """Two points or more, not all in one place."""
    return (F.size(geom) >= 2) & (line_length(geom) > 0)


def line_wkt(geom: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(geom, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def _zone(srid: Column) -> tuple[Column, Column]:
    """Central meridian in degrees and false northing of a UTM system."""
    north, south = (srid >= 32601) & (srid <= 32660), (srid >= 32701) & (srid <= 32760)
    zone = F.when(north, srid - 32600).when(south, srid - 32700).otherwise(F.raise_error(F.concat(F.lit("not a UTM system: "), srid.cast("string"))).cast("int"))
    return zone * 6 - 183, F.when(south, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))


def to_utm(lon: Column, lat: Column, srid: Column) -> tuple[Column, Column]:
    """Easting and northing of geographic positions."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    meridian, north = _zone(srid)
    phi, dl = F.radians(lat), F.radians(lon - meridian)
    n = F.lit(SEMI_MAJOR) / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, a = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * dl
    m = F.lit(SEMI_MAJOR) * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = F.lit(SCALE) * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * a**5 / 120)
    y = F.lit(SCALE) * (m + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * a**6 / 720))
    return x + FALSE_EAST, y + north


def from_utm(x: Column, y: Column, srid: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM positions."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    meridian, north = _zone(srid)
    mu = (y - north) / SCALE / (SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p1 = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t = ep2 * F.cos(p1) ** 2, F.tan(p1) ** 2
    w = 1 - e2 * F.sin(p1) ** 2
    n, rho = F.lit(SEMI_MAJOR) / F.sqrt(w), F.lit(SEMI_MAJOR * (1 - e2)) / (w * F.sqrt(w))
    d = (x - FALSE_EAST) / (n * SCALE)
    lat = p1 - (n * F.tan(p1) / rho) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / F.cos(p1)
    return F.degrees(lon) + meridian, F.degrees(lat)


@dataclasses.dataclass(frozen=True)
class Projection:
    """A map projection: ``mercator`` on the sphere, ``lambert`` (conformal, two parallels) or ``albers`` (equal area);
    angles in degrees, lengths in the unit of the semi-major axis."""

    kind: str
    lat0: float = 0.0
    lon0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    x0: float = 0.0
    y0: float = 0.0
    axis: float = SEMI_MAJOR
    flattening: float = FLATTENING

    @property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))


#: Systems by number besides UTM: world Mercator of web maps, and conics for France, the states of the USA and Europe (fixed values).
SYSTEMS = {
    3857: Projection("mercator"),
    2154: Projection("lambert", 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0, 6378137.0, 1 / 298.257222101),
    5070: Projection("albers", 23.0, -96.0, 29.5, 45.5, 0.0, 0.0, 6378137.0, 1 / 298.257222101),
    3034: Projection("lambert", 52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0, 6378137.0, 1 / 298.257222101),
}


def _conic(p: Projection) -> tuple[float, float, float]:
    """Cone constant, scale and radius at the origin."""
    e = p.e
    rad = {k: math.radians(getattr(p, k)) for k in ("lat0", "lat1", "lat2")}

    def m(x: float) -> float:
        return math.cos(x) / math.sqrt(1 - (e * math.sin(x)) ** 2)

    if p.kind == "lambert":
        t = {k: math.tan(math.pi / 4 - x / 2) / ((1 - e * math.sin(x)) / (1 + e * math.sin(x))) ** (e / 2) for k, x in rad.items()}
        n = (math.log(m(rad["lat1"])) - math.log(m(rad["lat2"]))) / (math.log(t["lat1"]) - math.log(t["lat2"])) if p.lat1 != p.lat2 else math.sin(rad["lat1"])
        f = m(rad["lat1"]) / (n * t["lat1"] ** n)
        return n, f, p.axis * f * t["lat0"] ** n
    q = {k: (1 - e * e) * (math.sin(x) / (1 - (e * math.sin(x)) ** 2) - math.log((1 - e * math.sin(x)) / (1 + e * math.sin(x))) / (2 * e)) for k, x in rad.items()}
    n = (m(rad["lat1"]) ** 2 - m(rad["lat2"]) ** 2) / (q["lat2"] - q["lat1"]) if p.lat1 != p.lat2 else math.sin(rad["lat1"])
    c = m(rad["lat1"]) ** 2 + n * q["lat1"]
    return n, c, p.axis * math.sqrt(c - n * q["lat0"]) / n


def projected(lon: Column, lat: Column, p: Projection) -> tuple[Column, Column]:
    """Easting and northing of geographic positions."""
    phi, e = F.radians(lat), p.e
    if p.kind == "mercator":
        return F.radians(lon - p.lon0) * p.axis + p.x0, F.log(F.tan(math.pi / 4 + phi / 2)) * p.axis + p.y0
    n, c, rho0 = _conic(p)
    s = e * F.sin(phi)
    if p.kind == "lambert":
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
        rho = p.axis * c * F.pow(t, F.lit(n))
    else:
        q = (1 - e * e) * (F.sin(phi) / (1 - s * s) - F.log((1 - s) / (1 + s)) / (2 * e))
        rho = p.axis * F.sqrt(c - n * q) / n
    turn = n * F.radians(lon - p.lon0)
    return rho * F.sin(turn) + p.x0, rho0 - rho * F.cos(turn) + p.y0


def unprojected(x: Column, y: Column, p: Projection) -> tuple[Column, Column]:
    """Longitude and latitude of projected positions; latitudes of conics by the usual series, exact to far below a millimetre."""
    if p.kind == "mercator":
        return F.degrees((x - p.x0) / p.axis) + p.lon0, F.degrees(2 * F.atan(F.exp((y - p.y0) / p.axis)) - math.pi / 2)
    n, c, rho0 = _conic(p)
    dx, dy, sign = x - p.x0, rho0 - (y - p.y0), 1.0 if n > 0 else -1.0
    rho, turn = F.sqrt(dx * dx + dy * dy) * sign, F.atan2(dx * sign, dy * sign)
    e2 = p.e**2
    if p.kind == "lambert":
        # conformal latitude, then geographic
        chi = math.pi / 2 - 2 * F.atan(F.pow(rho / (p.axis * c), F.lit(1 / n)))
        terms = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    else:
        pole = 1 - (1 - e2) / (2 * p.e) * math.log((1 - p.e) / (1 + p.e))
        chi = F.asin((c - (rho * n / p.axis) ** 2) / n / pole)
        terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    lat = chi
    for k, w in enumerate(terms, 1):
        lat = lat + w * F.sin(2 * k * chi)
    return F.degrees(turn / n) + p.lon0, F.degrees(lat)


def _by_system(srid: Column, one, other: tuple[Column, Column]) -> tuple[Column, Column]:
    """The pair of the systems of SYSTEMS where srid is one of them, else the other."""
    out = list(other)
    for code, p in SYSTEMS.items():
        pair = one(p)
        out = [F.when(srid == code, pair[k]).otherwise(out[k]) for k in (0, 1)]
    return out[0], out[1]


def geographic(x: Column, y: Column, srid: Column) -> tuple[Column, Column]:
    """Longitude and latitude of positions of any supported system; those in degrees stay."""
    lon, lat = _by_system(srid, lambda p: unprojected(x, y, p), from_utm(x, y, srid))
    return F.when(srid == 4326, x).otherwise(lon), F.when(srid == 4326, y).otherwise(lat)


def placed(lon: Column, lat: Column, srid: Column) -> tuple[Column, Column]:
    """Positions in any supported system of longitudes and latitudes."""
    x, y = _by_system(srid, lambda p: projected(lon, lat, p), to_utm(lon, lat, srid))
    return F.when(srid == 4326, lon).otherwise(x), F.when(srid == 4326, lat).otherwise(y)


def to_wgs84(geom: Column, srid: Column) -> Column:
    """Points in degrees; geographic ones stay as they are."""

    def one(p: Column) -> Column:
        lon, lat = geographic(p["x"], p["y"], srid)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(geom, one)


def reproject(geom: Column, source: Column, target: Column) -> Column:
    """Points from one supported system to another."""

    def one(p: Column) -> Column:
        x, y = placed(*geographic(p["x"], p["y"], source), target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(source == target, geom).otherwise(F.transform(geom, one))
