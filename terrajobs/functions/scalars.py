"""Column expressions: tiles, projections, planar vectors, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_WIDTH = 40075016.6855785  # metres around the equator in spherical Mercator
RADIUS = 6378137.0
TAU = 2 * math.pi

Num = Column | str | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lonlat_to_mercator(lon: Num, lat: Num) -> Column:
    """Degrees to spherical Mercator metres, as struct<x, y>."""
    return F.struct((F.radians(_c(lon)) * RADIUS).alias("x"), (F.ln(F.tan(F.radians(_c(lat)) / 2 + math.pi / 4)) * RADIUS).alias("y"))


def mercator_to_lonlat(x: Num, y: Num) -> Column:
    """Spherical Mercator metres to degrees, as struct<lon, lat>."""
    return F.struct(F.degrees(_c(x) / RADIUS).alias("lon"), F.degrees(2 * F.atan(F.exp(_c(y) / RADIUS)) - math.pi / 2).alias("lat"))


def mercator_tile(r: Num, x: Num, y: Num, srid: int = 3857) -> Column:
    """struct<x, y> of the tile at zoom ``r`` that holds the point; nulls count as 0.

    Latitudes beyond 89 degrees either way are taken as 89, positions beyond the map as its
    edge, and the index is kept within the zoom's tiles. y counts from the north.
    """
    r, x, y = (F.coalesce(_c(v), F.lit(0)) for v in (r, x, y))
    if srid == 4326:
        point = lonlat_to_mercator(x, F.greatest(F.least(y.cast("double"), F.lit(89.0)), F.lit(-89.0)))
        x, y = point["x"], point["y"]
    half = MAP_WIDTH / 2
    inside = lambda v: F.greatest(F.least(v.cast("double"), F.lit(half)), F.lit(-half))
    tiles = F.call_function("shiftleft", F.lit(1), r.cast("int"))
    index = lambda v: F.greatest(F.least(F.floor(v * tiles / MAP_WIDTH).cast("int"), tiles - 1), F.lit(0))
    return F.struct(index(inside(x) + half).alias("x"), index(half - inside(y)).alias("y"))


def _spread(v: Column) -> Column:
    v = F.greatest(F.coalesce(v.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(keep))
    return v


def morton_code(x: Num, y: Num) -> Column:
    """Interleaved bits as a long, x at the odd places; null or negative counts as 0."""
    return F.shiftleft(_spread(_c(x)), 1).bitwiseOR(_spread(_c(y)))


def morton_parent(code: Num, step: int) -> Column:
    """The code of the tile that many zoom levels up."""
    return F.shiftright(_c(code), 2 * step)


def planar_distance(x0: Num, y0: Num, x1: Num, y1: Num) -> Column:
    """Euclid; null if any coordinate is."""
    dx, dy = _c(x1) - _c(x0), _c(y1) - _c(y0)
    return F.sqrt(dx * dx + dy * dy)


def geo_distance(lon0: Num, lat0: Num, lon1: Num, lat1: Num, radius: float = 6371008.8) -> Column:
    """Great-circle metres on a sphere of the mean earth radius (within 0.6 % of a spheroid)."""
    a0, a1 = F.radians(_c(lat0)), F.radians(_c(lat1))
    h = F.pow(F.sin((a1 - a0) / 2), 2) + F.cos(a0) * F.cos(a1) * F.pow(F.sin(F.radians(_c(lon1) - _c(lon0)) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def midpoint(x0: Num, y0: Num, x1: Num, y1: Num) -> Column:
    return F.struct(((_c(x0) + _c(x1)) / 2).alias("x"), ((_c(y0) + _c(y1)) / 2).alias("y"))


def closest_point_on_segment(px: Num, py: Num, x0: Num, y0: Num, x1: Num, y1: Num) -> Column:
    """struct<x, y, dist>: the point's projection onto the segment, kept within its ends."""
    px, py, x0, y0, x1, y1 = (_c(v) for v in (px, py, x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0
    squared = dx * dx + dy * dy
    t = F.when(squared == 0, 0.0).otherwise(F.greatest(F.least(((px - x0) * dx + (py - y0) * dy) / squared, F.lit(1.0)), F.lit(0.0)))
    cx, cy = x0 + t * dx, y0 + t * dy
    return F.struct(cx.alias("x"), cy.alias("y"), planar_distance(px, py, cx, cy).alias("dist"))


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def segment_intersection(a: tuple, b: tuple) -> Column:
    """struct<x, y> where two segments (x0, y0, x1, y1) meet in one point, else null."""
    ax0, ay0, ax1, ay1 = (_c(v).cast("double") for v in a)
    bx0, by0, bx1, by1 = (_c(v).cast("double") for v in b)
    d = _cross(ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0)
    t = _cross(bx0 - ax0, by0 - ay0, bx1 - bx0, by1 - by0) / F.nullif(d, F.lit(0.0))
    u = _cross(bx0 - ax0, by0 - ay0, ax1 - ax0, ay1 - ay0) / F.nullif(d, F.lit(0.0))
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((ax0 + t * (ax1 - ax0)).alias("x"), (ay0 + t * (ay1 - ay0)).alias("y")))


def segment_distance(a: tuple, b: tuple) -> Column:
    """Least distance between two segments: 0 where they cross, else from an end."""
    ends = [closest_point_on_segment(a[0], a[1], *b), closest_point_on_segment(a[2], a[3], *b), closest_point_on_segment(b[0], b[1], *a), closest_point_on_segment(b[2], b[3], *a)]
    return F.when(segment_intersection(a, b).isNotNull(), F.lit(0.0)).otherwise(F.least(*[e["dist"] for e in ends]))


def angle_delta(dx0: Num, dy0: Num, dx1: Num, dy1: Num, sign: Num | None = None) -> Column:
    """Radians from the first to the second vector: with ``sign`` turned that way only, else
    the nearer way round. Null if either vector is zero."""
    dx0, dy0, dx1, dy1 = (_c(v).cast("double") for v in (dx0, dy0, dx1, dy1))
    turn = F.atan2(dy1, dx1) - F.atan2(dy0, dx0)
    near = F.when(turn > math.pi, turn - TAU).when(turn < -math.pi, turn + TAU).otherwise(turn)
    if sign is not None:
        s = _c(sign)
        forced = F.when((s < 0) & (turn > 0), turn - TAU).when((s > 0) & (turn < 0), turn + TAU).otherwise(turn)
        near = F.when(s.isNull(), near).otherwise(forced)
    return F.when(~((dx0 == 0) & (dy0 == 0) | (dx1 == 0) & (dy1 == 0)), near)


def along_distance(px: Num, py: Num, x: Num, y: Num, dx: Num, dy: Num) -> Column:
    """Signed length of (p - origin) along the vector; plain distance if the vector is zero."""
    px, py, x, y, dx, dy = (_c(v).cast("double") for v in (px, py, x, y, dx, dy))
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size == 0, planar_distance(x, y, px, py)).otherwise((dx * (px - x) + dy * (py - y)) / size)


def edge_score(px: Num, py: Num, x: Num, y: Num, dx: Num, dy: Num, sign: Num | None = None) -> Column:
    """A point's place relative to an edge: along the vector, or by angle about a pivot.

    With a sign, three quarters of a turn are taken off the turned angle and what falls
    below minus half a turn wraps, so points behind the edge are negative.
    """
    straight = along_distance(px, py, x, y, dx, dy)
    if sign is None:
        return straight
    s = _c(sign)
    turned = s * angle_delta(dx, dy, _c(px) - _c(x), _c(py) - _c(y), sign) - 0.75 * TAU
    return F.when(s.isNull(), straight).otherwise(F.when(turned < -TAU / 2, turned + TAU).otherwise(turned))


def strict_int(text: Num) -> Column:
    """The integer a text stands for, if writing it out gives the text again; else null."""
    value = _c(text).try_cast("long")
    return F.when(value.cast("string") == _c(text), value)


def thousands(value: Num) -> Column:
    return F.format_number(_c(value), 0)
