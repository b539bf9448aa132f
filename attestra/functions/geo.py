"""Places: distances, coordinates in text, quantities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def destination(lat: Column, lon: Column, km: Column, bearing: Column) -> tuple[Column, Column]:
    """Where a great circle ends."""
    d, b, p = km / EARTH_KM, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    dl = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), F.pmod(lon + F.degrees(dl) + 180, F.lit(360.0)) - 180


@F.pandas_udf(DoubleType())
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance on the WGS84 ellipsoid by Vincenty's inverse formula, the sphere's where it doesn't converge."""
    a, f = 6378.137, 1 / 298.257223563
    b = (1 - f) * a
    p1, l1, p2, l2 = (np.radians(x.to_numpy(float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, big = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2)), l2 - l1
    lam = big.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            sin_a = np.where(s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / s, 0)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 > 0, c - 2 * np.sin(u1) * np.sin(u2) / cos2, 0)
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = big + (1 - k) * f * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            if np.nanmax(np.abs(new - lam), initial=0) < 1e-12:
                break
            lam = new
        uu = cos2 * (a * a - b * b) / (b * b)
        big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        d = big_b * s * (mid + big_b / 4 * (c * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        out = b * big_a * (sigma - d)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(big / 2) ** 2
        out = np.where(np.isfinite(out), out, 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h))))
    return pd.Series(out)


@F.pandas_udf(StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())]))
def geodesic_destination(lat: pd.Series, lon: pd.Series, km: pd.Series, bearing: pd.Series) -> pd.DataFrame:
    """Where a geodesic of the WGS84 ellipsoid ends, by Vincenty's direct formula; nulls where any input is null."""
    a, f = 6378.137, 1 / 298.257223563
    b = (1 - f) * a
    p, l, w = (np.radians(x.to_numpy(float)) for x in (lat, lon, bearing))
    s = km.to_numpy(float)
    u = np.arctan((1 - f) * np.tan(p))
    start = np.arctan2(np.tan(u), np.cos(w))
    sin_a = np.cos(u) * np.sin(w)
    cos2 = 1 - sin_a**2
    uu = cos2 * (a * a - b * b) / (b * b)
    big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    straight = s / (b * big_a)
    sigma = straight.copy()
    for _ in range(30):
        mid = np.cos(2 * start + sigma)
        k, c = np.sin(sigma), np.cos(sigma)
        new = straight + big_b * k * (mid + big_b / 4 * (c * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * k**2 - 3) * (4 * mid**2 - 3)))
        if np.nanmax(np.abs(new - sigma), initial=0) < 1e-14:
            break
        sigma = new
    k, c, mid = np.sin(sigma), np.cos(sigma), np.cos(2 * start + sigma)
    to = np.arctan2(np.sin(u) * c + np.cos(u) * k * np.cos(w), (1 - f) * np.hypot(sin_a, np.sin(u) * k - np.cos(u) * c * np.cos(w)))
    lam = np.arctan2(k * np.sin(w), np.cos(u) * c - np.sin(u) * k * np.cos(w))
    big_c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
    east = lam - (1 - big_c) * f * sin_a * (sigma + big_c * k * (mid + big_c * c * (2 * mid**2 - 1)))
    return pd.DataFrame({"lat": np.degrees(to), "lon": (np.degrees(l + east) + 180) % 360 - 180})


def parse_dms(x: Column) -> Column:
    """Degrees of '12°34\\'56\"N' or '12 34 56 N'; null for anything else."""
    rx = r"^\s*(\d{1,3})[°\s]\s*(\d{1,2})['\s]\s*(\d{1,2}(?:\.\d+)?)[\"\s]*\s*([NSEW])\s*$"
    d, m, s = (F.regexp_extract(x, rx, i).try_cast("double") for i in (1, 2, 3))
    sign = F.when(F.regexp_extract(x, rx, 4).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (d + m / 60 + s / 3600)


def parse_decimal(x: Column) -> Column:
    """struct(lat, lon, precision) of '12.345, -67.8'; precision is the fewer decimals."""
    rx = r"^\s*(-?\d{1,2}(?:\.\d+)?)\s*[, ]\s*(-?\d{1,3}(?:\.\d+)?)\s*$"
    lat, lon = F.regexp_extract(x, rx, 1), F.regexp_extract(x, rx, 2)
    places = lambda c: F.length(F.regexp_extract(c, r"\.(\d+)$", 1))
    ok = F.abs(lat.try_cast("double")).between(0, 90) & F.abs(lon.try_cast("double")).between(0, 180)
    return F.when(ok, F.struct(lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon"), F.least(places(lat), places(lon)).alias("precision")))


def parse_quantity(x: Column) -> Column:
    """struct(low, high, unit, approx) of '12', '~12 units', '10-15 trucks'."""
    rx = r"^\s*(~|about |approx\. )?(\d+(?:\.\d+)?)(?:\s*[-–]\s*(\d+(?:\.\d+)?))?\s*([a-z]*)\s*$"
    low, high = F.regexp_extract(x, rx, 2).try_cast("double"), F.regexp_extract(x, rx, 3).try_cast("double")
    unit = F.regexp_extract(x, rx, 4)
    return F.struct(low.alias("low"), F.coalesce(high, low).alias("high"), F.when(unit != "", unit).alias("unit"), (F.regexp_extract(x, rx, 1) != "").alias("approx"))


def within_area(lat: Column, lon: Column, center: tuple[float, float], km: float) -> Column:
    """Null where there are no coordinates."""
    return haversine_km(lat, lon, F.lit(center[0]), F.lit(center[1])) <= km


def hex_hamming(a: Column, b: Column, digits: int = 16) -> Column:
    """How many bits two hexadecimal hashes of equal width differ in."""
    out = F.lit(0)
    for i in range(0, digits, 15):
        part = lambda c: F.conv(F.substring(c, i + 1, min(15, digits - i)), 16, 10).cast("long")  # noqa: E731, B023
        out = out + F.bit_count(part(a).bitwiseXOR(part(b)))
    return out
