"""Ring expressions: a ring is array<struct<x, y>> whose last point repeats the first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrajobs.functions.scalars import Num, closest_point_on_segment


def _pairs(ring: Column) -> Column:
    """array<struct<a, b>> of a ring's consecutive points."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(ring: Column, term) -> Column:  # noqa: ANN001
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda acc, p: acc + term(p["a"], p["b"]))


def signed_area(ring: Column) -> Column:
    """Shoelace; negative for clockwise rings."""
    return _total(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_length(ring: Column) -> Column:
    return _total(ring, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def ring_centroid(ring: Column) -> Column:
    """struct<x, y>, weighted by area; the mean of the points if the area is 0."""
    area = signed_area(ring)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.nullif(F.size(ring), F.lit(0))
    part = lambda k: F.when(area == 0, mean(k)).otherwise(_total(ring, lambda a, b: (a[k] + b[k]) * cross(a, b)) / (6 * F.nullif(area, F.lit(0.0))))
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def ring_bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def closest_point_on_ring(x: Num, y: Num, ring: Column) -> Column:
    """struct<dist, x, y>: the outline's point closest to (x, y)."""
    near = lambda p: closest_point_on_segment(x, y, p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])
    return F.array_min(F.transform(F.transform(_pairs(ring), near), lambda c: F.struct(c["dist"].alias("dist"), c["x"].alias("x"), c["y"].alias("y"))))


def ring_points(ring: Column) -> Column:
    return F.size(ring)


def orient_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)


def without_repeats(ring: Column) -> Column:
    """A ring without points equal to the one before them."""
    return F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))


def geo_area(ring: Column, radius: float = 6371008.8) -> Column:
    """Square metres on a sphere of a ring of degrees (x longitude, y latitude)."""
    rad = math.pi / 180
    total = _total(ring, lambda a, b: (b["x"] - a["x"]) * rad * (2 + F.sin(a["y"] * rad) + F.sin(b["y"] * rad)))
    return F.abs(total * radius * radius / 2)


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast: odd number of sides crossed eastwards."""
    crossed = F.aggregate(
        _pairs(ring),
        F.lit(0),
        lambda acc, p: acc
        + F.when(
            ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / (p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]),
            1,
        ).otherwise(0),
    )
    return crossed % 2 == 1
