"""Map projections as column expressions: transverse Mercator (UTM, series of sixth order in n) and spherical Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from landloom.functions.num import let

A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
#: Coefficients of the Krüger series, by power of n.
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
ALPHA = tuple(sum(c * N ** (i + 1) for i, c in enumerate(row)) for row in FORWARD)
BETA = tuple(sum(c * N ** (i + 1) for i, c in enumerate(row)) for row in INVERSE)
ECC = math.sqrt(FLAT * (2 - FLAT))


def utm_central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def utm_forward(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to easting and northing in metres."""

    def sphere(p: Column) -> Column:
        t = let(F.sin(p["y"]), lambda s: F.sinh(F.atanh(s) - ECC * F.atanh(s * ECC)))
        return let(_pair(t, F.cos(p["x"])), lambda q: _pair(F.atan2(q["x"], q["y"]), F.asinh(F.sin(p["x"]) / F.sqrt(q["x"] * q["x"] + q["y"] * q["y"]))))

    def series(p: Column) -> Column:
        xi, eta = p["x"], p["y"]
        x, y = eta, xi
        for j, a in enumerate(ALPHA, 1):
            x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
            y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
        return _pair(x * (K0 * RECTIFYING) + 500000.0, y * (K0 * RECTIFYING) + (10000000.0 if south else 0.0))

    out = let(let(_pair(F.radians(lon - utm_central_meridian(zone)), F.radians(lat)), sphere), series)
    return out["x"], out["y"]


def utm_inverse(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing to longitude and latitude; the latitude by three Newton steps."""

    def series(p: Column) -> Column:
        xi, eta = p["x"], p["y"]
        x, y = eta, xi
        for j, b in enumerate(BETA, 1):
            x = x - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
            y = y - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        return _pair(F.sinh(x), y)

    def sphere(p: Column) -> Column:
        t0 = F.sin(p["y"]) / F.sqrt(p["x"] * p["x"] + F.cos(p["y"]) * F.cos(p["y"]))
        lam = F.atan2(p["x"], F.cos(p["y"]))
        return _pair(F.degrees(lam) + utm_central_meridian(zone), F.degrees(F.atan(let(t0, newton))))

    def newton(t0: Column) -> Column:
        def step(t: Column, _: Column) -> Column:
            sigma = F.sinh(ECC * F.atanh(ECC * t / F.sqrt(t * t + 1)))
            ti = let(sigma, lambda s: t * F.sqrt(s * s + 1) - s * F.sqrt(t * t + 1))
            return let(ti, lambda ti: t + (t0 - ti) / F.sqrt(ti * ti + 1) * ((t * t * (1 - ECC**2) + 1) / (F.sqrt(t * t + 1) * (1 - ECC**2))))

        return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), t0, step)

    plane = _pair((northing - (10000000.0 if south else 0.0)) / (K0 * RECTIFYING), (easting - 500000.0) / (K0 * RECTIFYING))
    out = let(let(plane, series), sphere)
    return out["x"], out["y"]


def mercator_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(F.atan(F.exp(y / A)) * 2 - math.pi / 2)


#: EPSG code -> (zone, south) of the UTM systems on WGS 84 that parcels use.
UTM = {32642: (42, False), 32643: (43, False), 32644: (44, False), 32743: (43, True)}


def in_area_of_use(lon: Column, lat: Column, code: int) -> Column:
    """Whether longitude and latitude lie in the six degrees of a UTM zone, from the equator to 84 degrees north or 80 south."""
    zone, south = UTM[code]
    middle = utm_central_meridian(zone)
    return lon.between(middle - 3, middle + 3) & (lat.between(-80.0, 0.0) if south else lat.between(0.0, 84.0))


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """x and y between 4326, 3857 and the UTM systems of UTM; results that are not finite are null."""
    lon, lat = (x, y) if source == 4326 else mercator_inverse(x, y) if source == 3857 else utm_inverse(x, y, *UTM[source])
    a, b = (lon, lat) if target == 4326 else mercator_forward(lon, lat) if target == 3857 else utm_forward(lon, lat, *UTM[target])
    fine = lambda c: let(c, lambda v: F.when(~F.isnan(v) & (F.abs(v) < 1e12), v))
    return fine(a), fine(b)
