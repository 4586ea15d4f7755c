"""Column functions over places: boxes, distances, geometry texts and fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_MILES = 3958.8
METERS_PER_MILE = 1609.344


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """`minLon,minLat,maxLon,maxLat` as numbers; ValueError for anything else."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("bbox must be minLon,minLat,maxLon,maxLat")
    return tuple(float(p) for p in parts)  # type: ignore[return-value]


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Points inside or on a box; a null point is not."""
    return F.coalesce(lon.between(box[0], box[2]) & lat.between(box[1], box[3]), F.lit(False))


def resolved_geometry(geometry: Column, lat: Column, lon: Column) -> Column:
    """GeoJSON text: the given one, else a point where both coordinates are set, else null."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return F.coalesce(geometry, F.when(lat.isNotNull() & lon.isNotNull(), point))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = F.radians(lat1), F.radians(lon1), F.radians(lat2), F.radians(lon2)
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(h))


def near_box(lat: Column, lon: Column, lat0: float, lon0: float, miles: float) -> Column:
    """A box that holds every point within `miles`: a cheap test before the distance, pushed down to the scan."""
    import math

    dlat = miles / 68.7
    dlon = miles / max(1e-6, 68.7 * math.cos(math.radians(min(89.9, abs(lat0) + dlat))))
    return lat.between(lat0 - dlat, lat0 + dlat) & ((lon.between(lon0 - dlon, lon0 + dlon)) if dlon < 180 else F.lit(True))


def ewkt_point(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("SRID=4326;POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


@F.pandas_udf(T.DoubleType())
def spheroid_meters(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance on the WGS84 spheroid by Vincenty's inverse formula; the sphere's where it does not converge."""
    import numpy as np

    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    p1, p2, l = np.radians(lat1.to_numpy(float)), np.radians(lat2.to_numpy(float)), np.radians((lon2 - lon1).to_numpy(float))
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    lam = l.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2 = 1 - sin_a**2
            c2m = np.where(cos2 == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = l + (1 - c) * f * sin_a * (s + c * sin_s * (c2m + c * cos_s * (-1 + 2 * c2m**2)))
            done = np.nanmax(np.abs(new - lam)) < 1e-12 if len(new) and not np.isnan(new).all() else True
            lam = new
            if done:
                break
        u = cos2 * (a**2 - b**2) / b**2
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = big_b * sin_s * (c2m + big_b / 4 * (cos_s * (-1 + 2 * c2m**2) - big_b / 6 * c2m * (-3 + 4 * sin_s**2) * (-3 + 4 * c2m**2)))
        out = b * big_a * (s - ds)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(l / 2) ** 2
        out = np.where(np.isfinite(out), out, 2 * 6371008.8 * np.arcsin(np.sqrt(h)))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def shape_fingerprint(geometry: pd.Series) -> pd.Series:
    """Fingerprint of GeoJSON texts: `lon,lat` at six decimals for a plain point, else the SHA-1 of compact sorted JSON of type and coordinates rounded to six decimals; null for null."""
    import hashlib
    import json

    def rounded(v):
        return [rounded(x) for x in v] if isinstance(v, list) else round(float(v), 6)

    def one(text: str | None) -> str | None:
        if not text:
            return None
        shape = json.loads(text)
        at = shape.get("coordinates")
        if shape.get("type") == "Point" and isinstance(at, list) and len(at) == 2:
            return f"{at[0]:.6f},{at[1]:.6f}"
        plain = {"type": shape.get("type"), "coordinates": rounded(at) if isinstance(at, list) else at}
        return hashlib.sha1(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return geometry.map(one, na_action=None)


def point_fingerprint(lat: Column, lon: Column) -> Column:
    """`lon,lat` at six decimals, in the JVM; null without both."""
    six = lambda c: c.cast("decimal(18,6)").cast("string")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(six(lon), F.lit(","), six(lat)))


def with_fingerprint(rows: DataFrame, geometry: str = "geometry", lat: str = "lat", lon: str = "lon", name: str = "fingerprint") -> DataFrame:
    """Rows with their place's fingerprint: those without a geometry by their point, the others by shape_fingerprint().

    The two kinds are two branches, so that no point goes through Python: Spark would compute a Python function for every
    row of the one it stands in, also below a condition.
    """
    points = rows.filter(F.col(geometry).isNull()).withColumn(name, point_fingerprint(F.col(lat), F.col(lon)))
    shapes = rows.filter(F.col(geometry).isNotNull()).withColumn(name, shape_fingerprint(F.col(geometry)))
    return points.unionByName(shapes)


def grid_cell(lat: Column, lon: Column, bits: int = 12) -> Column:
    """Number of a place's cell in a grid of 2^bits by 2^bits over the globe, along a Z curve, so that near cells mostly have near numbers; null without both coordinates."""
    side = 1 << bits
    at = lambda c, low, span: F.least(F.greatest(F.floor((c - low) / span * side), F.lit(0)), F.lit(side - 1)).cast("long")
    x, y = at(lon, -180.0, 360.0), at(lat, -90.0, 180.0)
    spread = F.lit(0).cast("long")
    for k in range(bits):
        spread = spread + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1)
    return spread


@F.pandas_udf(T.BooleanType())
def shape_meets_box(geometry: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Whether a GeoJSON Point, Polygon or MultiPolygon touches the box (min lon, min lat, max lon, max lat); holes count as outside."""
    import json

    def cuts(p, q, box):  # segment against box (Liang-Barsky)
        t0, t1 = 0.0, 1.0
        for k in (0, 1):
            step = q[k] - p[k]
            for sign, limit in ((-1, box[k]), (1, box[k + 2])):
                room = sign * (limit - p[k])
                if step == 0:
                    if room < 0:
                        return False
                    continue
                t = room / (sign * step)
                if sign * step < 0:
                    t0 = max(t0, t)
                else:
                    t1 = min(t1, t)
        return t0 <= t1

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    def meets(rings, box):
        rings = [[(p[0], p[1]) for p in r] for r in rings]
        if any(cuts(p, q, box) for r in rings for p, q in zip(r, r[1:], strict=False)):
            return True
        x, y = box[0], box[1]  # no edge meets the box: it lies wholly in or out
        return bool(rings) and inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:])

    def one(text, *box):
        if not text:
            return False
        shape = json.loads(text)
        at = shape.get("coordinates") or []
        if shape.get("type") == "Point":
            return box[0] <= at[0] <= box[2] and box[1] <= at[1] <= box[3]
        polygons = [at] if shape.get("type") == "Polygon" else at if shape.get("type") == "MultiPolygon" else []
        return any(meets(p, box) for p in polygons)

    return pd.Series([one(*row) for row in zip(geometry, a, b, c, d, strict=True)], dtype=bool)
