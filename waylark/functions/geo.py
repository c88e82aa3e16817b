"""Geodesy on a sphere, as column expressions. Degrees, nautical miles, longitude before latitude in points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in nautical miles.
EARTH_NM = 3440.065
ARC_STEP_DEG, LEAST_ARC_STEPS, CIRCLE_STEPS = 5.0, 8, 144


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def distance_nm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by the haversine."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * F.asin(F.sqrt(h)) * EARTH_NM


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, from 0 to below 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lon: Column, lat: Column, course: Column, nm: Column) -> Column:
    """struct(lon, lat) of the point at a course and distance."""
    a, t, d = F.radians(_c(lat)), F.radians(_c(course)), _c(nm) / EARTH_NM
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(_c(lon)) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.struct(F.degrees(lon2).alias("lon"), F.degrees(lat2).alias("lat"))


def arc_sweep(start: Column, end: Column, turn: Column) -> Column:
    """Degrees from start to end: clockwise for R, the other way for L, else the shorter way."""
    cw = F.pmod(end - start + 360, F.lit(360.0))
    return F.when(cw == 0, 0.0).when(turn == "R", cw).when(turn == "L", cw - 360).when(cw <= 180, cw).otherwise(cw - 360)


def arc(lon: Column, lat: Column, radius: Column, start: Column, end: Column, turn: Column) -> Column:
    """Points of an arc, one for each five degrees and nine at least."""
    sweep = arc_sweep(start, end, turn)
    steps = F.greatest(F.lit(LEAST_ARC_STEPS), F.ceil(F.abs(sweep) / ARC_STEP_DEG).cast("int"))
    return F.transform(F.sequence(F.lit(0), steps), lambda i: destination(lon, lat, start + sweep * i / steps, radius))


def circle(lon: Column, lat: Column, radius: Column, steps: int = CIRCLE_STEPS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: destination(lon, lat, i * 360.0 / steps, radius))


def course_radial(lon: Column, lat: Column, course: Column, center_lon: Column, center_lat: Column, radial: Column) -> Column:
    """Where a course meets a radial, in the plane around the radial's centre: struct(along_course, along_radial), null if they are parallel or the point lies behind."""
    x, y = (lon - center_lon) * 60 * F.cos(F.radians(center_lat)), (lat - center_lat) * 60
    cx, cy, rx, ry = F.sin(F.radians(course)), F.cos(F.radians(course)), F.sin(F.radians(radial)), F.cos(F.radians(radial))
    den = cx * ry - cy * rx
    along_c, along_r = (y * rx - x * ry) / den, (y * cx - x * cy) / den
    return F.when((F.abs(den) >= 1e-6) & (along_c >= 0.05) & (along_r >= 0.05), F.struct(along_c.alias("along_course"), along_r.alias("along_radial")))


def dme_radial(code: Column) -> Column:
    """struct(radial, distance) of a fix named D, three digits and a letter that counts miles from A."""
    ok = code.rlike(r"^D\d{3}[A-Z]$")
    return F.when(ok, F.struct(F.substring(code, 2, 3).try_cast("int").alias("radial"), (F.ascii(F.substring(code, 5, 1)) - 64).alias("distance")))


def dms(text: Column) -> Column:
    """Decimal degrees of compact text such as 013812.5N or 1034015E; null for anything else."""
    p = r"^(\d{2,3})(\d{2})(\d{2}(\.\d+)?)([NSEW])$"
    g = lambda i: F.regexp_extract(F.upper(F.trim(text)), p, i)
    value = g(1).try_cast("double") + g(2).try_cast("double") / 60 + g(3).try_cast("double") / 3600
    return F.when(g(5).isin("S", "W"), -value).when(g(5) != "", value)


def valid_coordinate(lon: Column, lat: Column) -> Column:
    """There, in range and not (0, 0), which stands for unknown."""
    return F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~((lon == 0) & (lat == 0)), F.lit(False))


def bbox(points: Column) -> Column:
    """struct(west, south, east, north) of an array of points."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def polyline_nm(points: Column) -> Column:
    """Length of a polyline."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: distance_nm(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(F.size(points) > 1, F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def circular_apart(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def opposite_sector(dx: Column, dy: Column) -> Column:
    """Of eight compass sectors the one opposite to a vector, where a label is clear of lines."""
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    angle = F.pmod(F.degrees(F.atan2(-dx, -dy)) + 360 + 22.5, F.lit(360.0))
    return F.when((dx == 0) & (dy == 0), "N").otherwise(F.get(names, F.floor(angle / 45).cast("int")))
