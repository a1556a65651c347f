"""Overlay of polygons and assembly of rings, against areas and walks in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from terrajobs.functions import polygons
from terrajobs.operators import outlines, overlay

SCHEMA = "id long, ring array<struct<x:double,y:double>>, stateid long, border boolean, x0 string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [(float(x), float(y)) for x, y in r], i % 2, bool(b), "x", 1) for i, r, b in rows], SCHEMA)


def box(x, y, w, h):
    return [(x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y)]


def area(ring):
    p = np.array(ring, float)
    return abs(polygons.signed_area(p[:-1]))


def star(rng, x, y, n, size):
    """A simple polygon around a centre, with corners at random distances."""
    corners = []
    for k in range(n):
        turn, far = 2 * np.pi * (k + 0.8 * rng.random()) / n, size * (0.2 + rng.random())
        corners.append((x + far * np.cos(turn), y + far * np.sin(turn)))
    return [*corners, corners[0]]


def test_common_parts_of_any_shape(spark):
    rng = random.Random(12)
    polys = [(i, star(rng, rng.uniform(0, 12), rng.uniform(0, 12), rng.randrange(5, 9), 3), 0) for i in range(12)]
    regions = [(i, star(rng, rng.uniform(0, 12), rng.uniform(0, 12), 11, 6), 0) for i in range(4)]
    polys += [(50, None, 0), (51, [(0, 0), (1, 1), (0, 0)], 0), (52, [(9, 9)] * 5, 0)]
    got = overlay.chop_by_region(table(spark, polys), table(spark, regions), 2.5).collect()
    total = Counter()
    for r in got:
        assert r.ring[0] == r.ring[-1] and abs(area(r.ring) - sum(map(area, r.holes)) - r.area) < 1e-6
        total[r.id, r.region] += r.area
    assert [r.newid for r in got] and sorted(r.newid for r in got) == list(range(1, len(got) + 1))
    corners = lambda ring: np.array(ring, float)[:-1]
    for i, p, _ in polys[:12]:
        for j, q, _ in regions:
            assert abs(total[i, j] - polygons.common_area(corners(p), corners(q))) < 1e-5


def test_pieces_and_holes(spark):
    cup = [(0, 0), (0, 10), (3, 10), (3, 3), (7, 3), (7, 10), (10, 10), (10, 0), (0, 0)]
    real = lambda ring: [(float(x), float(y)) for x, y in ring]
    frame = [(1, 5, real(box(0, 0, 9, 9)), [real(box(3, 3, 3, 3))])]
    polys = [(1, box(-1, 5, 12, 2), 0), (2, box(4, 4, 1, 1), 0), (3, box(1, 1, 2, 2), 0), (4, box(-5, -5, 30, 30), 0), (5, box(3, 3, 4, 7)[::-1], 0)]
    got = overlay.chop_by_region(table(spark, polys), table(spark, [(9, cup, 0)]), 2.5).collect()
    assert sorted((r.id, r.area, len(r.ring)) for r in got) == [(1, 6.0, 5), (1, 6.0, 5), (3, 4.0, 5), (4, 72.0, 9)]
    region = spark.createDataFrame(frame, "id long, stateid long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    got = overlay.chop_by_region(table(spark, polys[:4]), region, 2.5).collect()
    assert sorted((r.id, r.area, len(r.holes)) for r in got) == [(1, 15.0, 0), (3, 4.0, 0), (4, 72.0, 1)]
    assert overlay.chop_by_region(table(spark, []), region, 2.5).count() == 0


def test_waters_and_land(spark):
    ws = [(1, box(0, 0, 10, 10), 0), (2, box(10, 0, 10, 10), 1), (3, box(20, 0, 10, 10), 1), (4, box(0, 20, 2, 2), 0), (5, box(50, 50, 1, 1), 1), (6, box(30, 30, 2, 2), 0)]
    water = [(1, box(2, 2, 2, 2), 0), (2, box(6, 6, 8, 2), 0), (3, box(-1, 19, 5, 5), 0), (4, box(4, 2, 1, 2), 0)]
    land = [(7, box(10, 0, 3, 20), 0), (8, box(15, 0, 9, 9), 0)]
    got = overlay.mask_by_coast(table(spark, ws), table(spark, water), table(spark, land), 2.5).collect()
    assert sorted((r.id, r.area, len(r.ring or []), len(r.holes)) for r in got) == [(1, 86.0, 9, 1), (2, 6.0, 5, 0), (2, 18.0, 5, 0), (2, 45.0, 5, 0), (3, 36.0, 5, 0), (4, 0.0, 0, 0), (5, 0.0, 0, 0), (6, 4.0, 5, 0)]
    (hole,) = next(r.holes for r in got if r.id == 1)
    assert sorted(tuple(p) for p in hole[:-1]) == [(2.0, 2.0), (2.0, 4.0), (5.0, 2.0), (5.0, 4.0)]  # the edge between two waters is gone


def plain_rings(cells):
    """Rings of a set of unit cells, the sharpest right turn first."""
    darts = set()
    for x, y in cells:
        for a, b in (((x, y), (x, y + 1)), ((x, y + 1), (x + 1, y + 1)), ((x + 1, y + 1), (x + 1, y)), ((x + 1, y), (x, y))):
            darts ^= {(a, b)} if (b, a) not in darts else {(b, a)}
    out = set()
    while darts:
        ring = [min(darts)]
        while True:
            (px, py), (x, y) = ring[-1]
            ways = [d for d in darts if d[0] == (x, y)]
            turn = lambda d: (x - px) * (d[1][1] - y) - (y - py) * (d[1][0] - x)  # noqa: E731, B023
            nxt = min(ways, key=turn)
            if nxt == ring[0]:
                break
            ring.append(nxt)
        out.add(tuple(ring))
        darts -= set(ring)
    return out


@pytest.mark.parametrize("share", [0.4, 0.6, 0.9])
def test_rings_in_order(spark, share):
    rng = random.Random(int(share * 10))
    groups = {g: {(x, y) for x in range(14) for y in range(14) if rng.random() < share} for g in (1, 2)}
    groups[3] = {(x, y) for x in range(150) for y in range(3)}
    rows = [(g, float(ax), float(ay), float(bx), float(by)) for g, cells in groups.items() for x, y in cells for (ax, ay), (bx, by) in (((x, y), (x, y + 1)), ((x, y + 1), (x + 1, y + 1)), ((x + 1, y + 1), (x + 1, y)), ((x + 1, y), (x, y)))]
    df = spark.createDataFrame(rows, "g long, x0 double, y0 double, x1 double, y1 double")
    found = {}
    for r in outlines.rings(outlines.outline_segments(df, ["g"]), ["g"]).collect():
        found.setdefault((r.g, r.ring), []).append((r.ordinal, (r.x0, r.y0), (r.x1, r.y1)))
    got = {(g, tuple(d[1:] for d in sorted(v))) for (g, _), v in found.items()}
    assert all([o for o, *_ in sorted(v)] == list(range(len(v))) for v in found.values())
    assert got == {(g, ring) for g, cells in groups.items() for ring in plain_rings(cells)}


def test_open_chains_have_no_ring(spark):
    rows = [(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 2.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0), (2, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "g long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.g, len(r.ring)) for r in outlines.stitch_rings(df, ["g"]).collect()] == [(2, 4)]
    assert outlines.rings(df.limit(0), ["g"]).count() == 0
