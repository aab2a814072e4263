"""Geospatial functions: points are (lon, lat) columns, polygons arrays of struct(x, y)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed values of the encoding


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def point_in_circle(lon: Column, lat: Column, clon: Column, clat: Column, radius_m: Column) -> Column:
    return haversine(lon, lat, clon, clat) <= radius_m


def point_in_bbox(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def _edges(poly: Column) -> Column:
    """struct(p, q) for each side of a closed ring given with or without its last point."""
    return F.transform(
        F.sequence(F.lit(1), F.size(poly)),
        lambda i: F.struct(
            F.element_at(poly, i).alias("p"), F.element_at(poly, (i % F.size(poly) + 1).cast("int")).alias("q")))


def area(poly: Column) -> Column:
    twice = F.aggregate(_edges(poly), F.lit(0.0), lambda s, e: s + e.p.x * e.q.y - e.q.x * e.p.y)
    return F.abs(twice) / 2


def length(line: Column) -> Column:
    """Planar length of an open line."""
    sides = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))),
        lambda i: F.struct(F.element_at(line, i).alias("p"), F.coalesce(F.try_element_at(line, i + 1), F.element_at(line, i)).alias("q")))
    return F.aggregate(sides, F.lit(0.0), lambda s, e: s + F.hypot(e.p.x - e.q.x, e.p.y - e.q.y))


def centroid(points: Column) -> Column:
    """Mean of the points."""
    def mean(f: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f]) / F.size(points)

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def contains(poly: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of sides lies right of the point."""
    crossed = F.aggregate(
        _edges(poly), F.lit(0),
        lambda n, e: n + F.when(
            ((e.p.y > y) != (e.q.y > y))
            & (x < e.p.x + (e.q.x - e.p.x) * (y - e.p.y) / F.when(e.q.y != e.p.y, e.q.y - e.p.y).otherwise(F.lit(1.0))), 1).otherwise(0))
    return crossed % 2 == 1


def envelope(points: Column) -> Column:
    def of(f, name):
        return f(F.transform(points, lambda p: p[name]))

    return F.struct(of(F.array_min, "x").alias("x1"), of(F.array_min, "y").alias("y1"), of(F.array_max, "x").alias("x2"), of(F.array_max, "y").alias("y2"))


def boxes_intersect(a: Column, b: Column) -> Column:
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def buffer(x: Column, y: Column, r: Column, sides: int = 16) -> Column:
    """A regular polygon about a point."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(sides - 1)),
        lambda i: F.struct((x + r * F.cos(i * (2 * 3.141592653589793 / sides))).alias("x"), (y + r * F.sin(i * (2 * 3.141592653589793 / sides))).alias("y")))


def as_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def from_text(wkt: Column) -> Column:
    """Points of a POINT, LINESTRING or one-ring POLYGON text."""
    return F.transform(
        F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+ -?[0-9.]+)"), F.lit(1)),
        lambda s: F.struct(F.element_at(F.split(s, " "), 1).cast("double").alias("x"), F.element_at(F.split(s, " "), 2).cast("double").alias("y")))


def geohash(lon: Column, lat: Column, precision: int = 6) -> Column:
    """Bits of longitude and latitude interleaved, five to a letter."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    ix = F.least(F.floor((lon + 180) / 360 * (1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    iy = F.least(F.floor((lat + 90) / 180 * (1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    out = []
    for c in range(precision):
        value = F.lit(0)
        for k in range(5):
            at = 5 * c + k  # even places are longitude
            src, shift = (ix, nx - 1 - at // 2) if at % 2 == 0 else (iy, ny - 1 - at // 2)
            value = value * 2 + F.pmod(F.shiftright(src, shift), F.lit(2)).cast("int")
        out.append(F.substring(F.lit(GEOHASH_ALPHABET), value + 1, F.lit(1)))
    return F.concat(*out)


def geohash_decode(code: Column, precision: int = 6) -> Column:
    """struct(lon, lat) of the cell's centre."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in range(precision):
        v = F.instr(F.lit(GEOHASH_ALPHABET), F.substring(code, c + 1, 1)) - 1
        for k in range(5):
            bit = F.pmod(F.shiftright(v, 4 - k), F.lit(2))
            if (5 * c + k) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    return F.struct(((x + 0.5) / (1 << nx) * 360 - 180).alias("lon"), ((y + 0.5) / (1 << ny) * 180 - 90).alias("lat"))
