"""Angles on the sky as column expressions (low-precision almanac formulas, UTC taken as UT1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEG = 0.017453292519943295


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def vector_angle(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Degrees between two vectors; null where one has no length."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.degrees(F.acos(clip(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), -1.0, 1.0)))


def unit_vector(lon_deg: Column, lat_deg: Column) -> tuple[Column, Column, Column]:
    lon, lat = lon_deg * DEG, lat_deg * DEG
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def sun_vector(mjd: Column) -> tuple[Column, Column, Column]:
    """Direction of the sun in equatorial coordinates, good to about 0.01 degrees."""
    n = mjd - F.lit(51544.5)
    mean, anomaly = F.lit(280.460) + F.lit(0.9856474) * n, (F.lit(357.528) + F.lit(0.9856003) * n) * DEG
    lon = (mean + F.lit(1.915) * F.sin(anomaly) + F.lit(0.020) * F.sin(2 * anomaly)) * DEG
    tilt = (F.lit(23.439) - F.lit(4e-7) * n) * DEG
    return F.cos(lon), F.cos(tilt) * F.sin(lon), F.sin(tilt) * F.sin(lon)


def solar_elongation(mjd: Column, ra_deg: Column, dec_deg: Column) -> Column:
    """Degrees between a source and the sun, 0 to 180."""
    return vector_angle(sun_vector(mjd), unit_vector(ra_deg, dec_deg))


def sidereal_deg(mjd: Column, east_lon_deg: Column) -> Column:
    """Local mean sidereal time in degrees."""
    d = mjd - F.lit(51544.5)
    t = d / F.lit(36525.0)
    return F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * d + F.lit(0.000387933) * t * t + east_lon_deg, F.lit(360.0))


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """East longitude and geodetic latitude in degrees of a geocentric position (Bowring, WGS84)."""
    a, f = 6378137.0, 1 / 298.257223563
    b, e2 = a * (1 - f), f * (2 - f)
    ep2 = e2 / (1 - e2)
    p = F.sqrt(x * x + y * y)
    u = F.atan2(z * a, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(u), F.lit(3)), p - e2 * a * F.pow(F.cos(u), F.lit(3)))
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def horizon(mjd: Column, ra_deg: Column, dec_deg: Column, lon_deg: Column, lat_deg: Column) -> dict[str, Column]:
    """elevation_deg, airmass (sec z, above the horizon only) and parallactic_angle_deg."""
    h = (sidereal_deg(mjd, lon_deg) - ra_deg) * DEG
    dec, lat = dec_deg * DEG, lat_deg * DEG
    up = clip(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(h), -1.0, 1.0)
    turn = F.atan2(F.sin(h), F.tan(lat) * F.cos(dec) - F.sin(dec) * F.cos(h))
    return {"elevation_deg": F.degrees(F.asin(up)), "airmass": F.when(up > 0, F.lit(1.0) / up), "parallactic_angle_deg": F.degrees(turn)}


def to_equatorial(kind: str, lon: float, lat: float) -> tuple[float, float]:
    """(ra, dec) in degrees of ecliptic or galactic coordinates in degrees (J2000)."""
    import math

    if kind == "equatorial":
        return lon % 360.0, lat
    v = [math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))]
    if kind == "ecliptic":
        e = math.radians(23.4392911)
        w = [v[0], math.cos(e) * v[1] - math.sin(e) * v[2], math.sin(e) * v[1] + math.cos(e) * v[2]]
    elif kind == "galactic":
        # rows: galactic axes in equatorial coordinates (pole 192.85948, 27.12825; centre longitude 122.93192)
        pole_ra, pole_dec, node = math.radians(192.85948), math.radians(27.12825), math.radians(122.93192)
        b, dl = math.radians(lat), node - math.radians(lon)
        sin_dec = math.sin(pole_dec) * math.sin(b) + math.cos(pole_dec) * math.cos(b) * math.cos(dl)
        y = math.cos(b) * math.sin(dl)
        x = math.cos(pole_dec) * math.sin(b) - math.sin(pole_dec) * math.cos(b) * math.cos(dl)
        return math.degrees(pole_ra + math.atan2(y, x)) % 360.0, math.degrees(math.asin(sin_dec))
    else:
        raise ValueError(f"unknown coordinates {kind}")
    return math.degrees(math.atan2(w[1], w[0])) % 360.0, math.degrees(math.asin(max(-1.0, min(1.0, w[2]))))
