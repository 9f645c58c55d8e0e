"""Distances and projections on the WGS84 ellipsoid, on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

# The WGS84 ellipsoid.
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)


def geodesic(lon1, lat1, lon2, lat2):
    """(distance in metres, azimuth at the start in degrees) by Vincenty's inverse iteration; points
    that are nearly opposite, where it does not settle, get the great circle of the mean radius."""
    lon1, lat1, lon2, lat2 = (np.asarray(x, dtype=float) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    span = np.radians((lon2 - lon1 + 540.0) % 360.0 - 180.0)
    lam, settled = span.copy(), np.zeros(span.shape, dtype=bool)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca2 = 1 - sa**2
            cm = np.where(ca2 > 1e-15, cs - 2 * s1 * s2 / ca2, 0.0)
            k = FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))
            nxt = span + (1 - k) * FLATTENING * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
            settled = np.abs(nxt - lam) < 1e-12
            lam = nxt
            if settled.all():
                break
        v = ca2 * (A**2 - B**2) / B**2
        p = 1 + v / 16384 * (4096 + v * (v * (320 - 175 * v) - 768))
        q = v / 1024 * (256 + v * (v * (74 - 47 * v) - 128))
        d = q * ss * (cm + q / 4 * (cs * (2 * cm**2 - 1) - q / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        distance = B * p * (sigma - d)
        azimuth = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))
    great = 6_371_008.8 * np.arctan2(np.hypot(c2 * np.sin(span), c1 * s2 - s1 * c2 * np.cos(span)), s1 * s2 + c1 * c2 * np.cos(span))
    return np.where(settled, distance, great), azimuth


@pandas_udf(DoubleType())
def geodesic_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(lon1, lat1, lon2, lat2)[0]).where(lon1.notna() & lat1.notna() & lon2.notna() & lat2.notna())


@pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def local_point(lon0: pd.Series, lat0: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    """Metres east and north of a centre, at the true distance and azimuth from it."""
    distance, azimuth = geodesic(lon0, lat0, lon, lat)
    return pd.DataFrame({"x": distance * np.sin(np.radians(azimuth)), "y": distance * np.cos(np.radians(azimuth))})


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point; Web Mercator beyond its latitudes."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return F.when((lat < -80) | (lat > 84), 3857).when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def transverse_mercator(lon, lat, central):
    """(east, north) in metres from the central meridian and the equator, Krueger's series to the fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * np.sqrt(n) / (1 + n)
    phi, lam = np.radians(lat), np.radians((np.asarray(lon) - central + 540.0) % 360.0 - 180.0)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.hypot(1, t))
    north = xi + sum(a * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, a in enumerate(alpha, 1))
    east = eta + sum(a * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, a in enumerate(alpha, 1))
    return 0.9996 * radius * east, 0.9996 * radius * north


@pandas_udf(StructType([StructField("east", DoubleType()), StructField("north", DoubleType())]))
def utm_point(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    zone = np.minimum(np.floor((lon + 180) / 6), 59)
    east, north = transverse_mercator(lon, lat, zone * 6 - 177)
    return pd.DataFrame({"east": 500_000 + east, "north": np.where(lat < 0, 10_000_000 + north, north)})


def spherical_centroid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the mean unit vector of a group; (aggregates)."""
    x = F.avg(F.cos(F.radians(lat)) * F.cos(F.radians(lon)))
    y = F.avg(F.cos(F.radians(lat)) * F.sin(F.radians(lon)))
    z = F.avg(F.sin(F.radians(lat)))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def antimeridian_parts(lon1: float, lat1: float, lon2: float, lat2: float) -> list[list[list[float]]]:
    """Line strings of the short line between two points, cut where it crosses the 180th meridian."""
    if abs(lon2 - lon1) <= 180:
        return [[[lon1, lat1], [lon2, lat2]]]
    side = 180.0 if lon1 > 0 else -180.0
    reach = side - lon1
    whole = (lon2 - lon1 + 540.0) % 360.0 - 180.0
    cut = lat1 + (lat2 - lat1) * reach / whole if whole else lat1
    return [[[lon1, lat1], [side, cut]], [[-side, cut], [lon2, lat2]]]
