"""Rings as rows: segments, runs, roll-ups, overlap areas, closing gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrajobs.functions.polygons import Window2D, points
from terrajobs.functions.rings import ring_area
from terrajobs.functions.scalars import along_distance, planar_distance
from terrajobs.operators.joins import bbox_join, mutual_nearest, near_crossings
from terrajobs.operators.ordering import best_per, with_dense_id
from terrajobs.operators.outlines import XY
from terrajobs.operators.summaries import closest_endpoints
from terrajobs.storage import discard, stash

# --- rings and segments ----------------------------------------------------------------


def ring_points(polys: DataFrame, id_col: str = "wsid") -> DataFrame:
    """(id, ordinal, x, y) of each ring's points, the closing point left out."""
    return polys.select(id_col, F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("ordinal", "p")).select(id_col, (F.col("ordinal") + 1).alias("ordinal"), "p.x", "p.y")


def ring_segments(points: DataFrame, keys: list[str], order: str = "ordinal", closed: bool = False) -> DataFrame:
    """Consecutive points of each ring (or part) as segments (keys, ordinal, x0, y0, x1, y1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = points.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w))
    if closed:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("x1", F.coalesce("x1", F.first("x").over(whole))).withColumn("y1", F.coalesce("y1", F.first("y").over(whole)))
    return rows.filter("x1 is not null").select(*keys, F.col(order).alias("ordinal"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def segment_boxes(segments: DataFrame, margin: float) -> DataFrame:
    """Add the box around each segment grown by ``margin``."""
    return segments.selectExpr("*", f"least(x0, x1) - {margin} as minx", f"least(y0, y1) - {margin} as miny", f"greatest(x0, x1) + {margin} as maxx", f"greatest(y0, y1) + {margin} as maxy")


def assemble_rings(points: DataFrame, updates: DataFrame | None = None, id_col: str = "wsid") -> DataFrame:
    """Point rows back to one closed ring per polygon; an updated position is preferred."""
    if updates is not None:
        new = updates.select(id_col, "ordinal", F.col("x").alias("_x"), F.col("y").alias("_y"))
        points = points.join(new, [id_col, "ordinal"], "left").withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y"))
    listed = points.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ordinal", "x", "y"))).alias("p"))
    ring = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return listed.select(id_col, F.concat(ring, F.slice(ring, 1, 1)).alias("ring"))


def ordinal_bounds(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def neighbor_runs(connected: DataFrame) -> DataFrame:
    """Maximal runs of one neighbour along each ring, the last joined to the first if their
    neighbour is the same.

    Takes (id, wsid, ordinal, neighbor, x0, y0, x1, y1). Returns wsid, runid, wsid1,
    first, last (ordinals in walking order), length, line, and connectionid: the smaller of
    a run's id and its twin's, a run's id being its first segment's. A polygon with one
    neighbour all round has a single run with neighbour 0.
    """
    w = Window.partitionBy("wsid").orderBy("ordinal")
    rows = connected.withColumn("_new", (F.coalesce(F.lag("neighbor").over(w) != F.col("neighbor"), F.lit(True))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    ends = rows.groupBy("wsid").agg(F.min_by("neighbor", "ordinal").alias("_n0"), F.max_by("neighbor", "ordinal").alias("_n1"), F.max("_run").alias("_last"), F.max("ordinal").alias("_max"))
    rows = rows.join(ends, "wsid")
    wraps = (F.col("_run") == F.col("_last")) & (F.col("_n0") == F.col("_n1")) & (F.col("_last") > 1)
    rows = rows.withColumn("_place", F.when(wraps, F.col("ordinal") - F.col("_max") - 1).otherwise(F.col("ordinal"))).withColumn("_run", F.when(wraps, F.lit(1)).otherwise(F.col("_run")))
    step = planar_distance("x0", "y0", "x1", "y1")
    point = F.struct("_place", F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("a"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("b"))
    runs = rows.groupBy("wsid", "_run").agg(
        F.min_by("id", "_place").alias("runid"),
        F.when(F.first("_last") == 1, F.lit(0)).otherwise(F.first("neighbor")).alias("wsid1"),
        F.min_by("ordinal", "_place").alias("first"),
        F.max_by("ordinal", "_place").alias("last"),
        F.sum(step).alias("length"),
        F.sort_array(F.collect_list(point)).alias("_p"),
    )
    line = F.concat(F.slice(F.transform("_p", lambda p: p["a"]), 1, 1), F.transform("_p", lambda p: p["b"]))
    runs = runs.select("wsid", "runid", "wsid1", "first", "last", "length", line.alias("line"))
    ends_of = lambda a, b: [F.element_at("line", a)[k].alias(f"{k}{i}") for i, a in ((0, a), (1, b)) for k in ("x", "y")]
    mine = runs.select("*", *ends_of(1, -1))
    twin = runs.select(F.col("runid").alias("_twin"), F.col("wsid").alias("_w1"), F.col("wsid1").alias("_w0"), *[c.alias("_" + n) for c, n in zip([F.element_at("line", e)[k] for e in (-1, 1) for k in ("x", "y")], ("x0", "y0", "x1", "y1"), strict=True)])
    same = (F.col("wsid") == F.col("_w0")) & (F.col("wsid1") == F.col("_w1")) & (F.col("x0") == F.col("_x0")) & (F.col("y0") == F.col("_y0")) & (F.col("x1") == F.col("_x1")) & (F.col("y1") == F.col("_y1"))
    return mine.join(twin, same, "left").select("wsid", "runid", "wsid1", F.least("runid", "_twin").alias("connectionid"), "first", "last", "length", "line")


def boundary_flags(connections: DataFrame) -> DataFrame:
    """(wsid, boundary): whether any interface faces outside (neighbour 0)."""
    return connections.groupBy(F.col("wsid0").alias("wsid")).agg(F.max(F.col("wsid1") == 0).alias("boundary"))


def drop_doublebacks(segments: DataFrame, owner: str = "wsid") -> DataFrame:
    """Remove segments reversed within their own polygon, one of each kind a round, until
    none is left. Takes (id, owner, x0, y0, x1, y1)."""
    rest = segments
    while True:
        back = rest.select(F.col(owner).alias("_o"), F.col("x1").alias("_x0"), F.col("y1").alias("_y0"), F.col("x0").alias("_x1"), F.col("y0").alias("_y1")).distinct()
        same = (F.col(owner) == F.col("_o")) & (F.col("x0") == F.col("_x0")) & (F.col("y0") == F.col("_y0")) & (F.col("x1") == F.col("_x1")) & (F.col("y1") == F.col("_y1"))
        gone = stash(rest.join(back, same, "left_semi").groupBy(owner, "x0", "y0", "x1", "y1").agg(F.min("id").alias("id")).select("id"), "doubleback")
        if not gone.limit(1).count():
            return rest
        rest = stash(rest.join(gone, "id", "left_anti"), "segments")


def retrace_map(segments: DataFrame, owner: str = "wsid") -> DataFrame:
    """Per directed segment: polygons on its own side and on its reverse; 1:1 is finished.

    Positions a polygon runs more often forth than back count once for it, so collapsed
    double-backs do not.
    """
    own = segments.groupBy(owner, "x0", "y0", "x1", "y1").agg(F.count_distinct("id").alias("n"))
    back = own.select(F.col(owner).alias("_o"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("n").alias("m"))
    keys = ["x0", "y0", "x1", "y1"]
    net = own.join(back.withColumnRenamed("_o", owner), [owner, *keys], "left").filter("n > coalesce(m, 0)").select(owner, *keys)
    ahead = net.groupBy(*keys).agg(F.count("*").alias("own_side"))
    behind = ahead.select(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("own_side").alias("reverse_side"))
    return ahead.join(behind, keys, "left").withColumn("reverse_side", F.coalesce("reverse_side", F.lit(0))).withColumn("finished", F.expr("own_side = 1 and reverse_side = 1"))


def largest_part(parts: DataFrame, id_col: str = "wsid") -> DataFrame:
    """The biggest piece of each id; ties by part."""
    return best_per(parts, [id_col], ["-area", "part"])


def split_parts(parts: DataFrame, id_col: str = "wsid") -> DataFrame:
    """All pieces: the biggest keeps its id, others get new serial ids above the largest."""
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("area").desc(), "part")))
    top = parts.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    new = with_dense_id(ranked.filter("_rank > 1"), [id_col, "_rank"], "newid", int(top) + 1)
    return ranked.filter("_rank = 1").withColumn("newid", F.col(id_col)).unionByName(new).drop("_rank")


def snap_segment(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Cut segments (id, x0, y0, x1, y1) at points (segid, x, y), in order along them.

    Returns (id, piece, x0, y0, x1, y1); segments without a point stay whole.
    """
    at = points.groupBy("segid").agg(F.collect_list(F.struct("x", "y")).alias("pts"))
    rows = segments.join(at, F.col("id") == F.col("segid"), "left")
    end = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    keyed = F.transform(F.coalesce("pts", F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.struct(along_distance(p["x"], p["y"], "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("d"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    path = F.concat(F.array(end("x0", "y0")), F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(end("x1", "y1")))
    rows = rows.select("id", path.alias("path"))
    pieces = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rows.select("id", F.posexplode(pieces).alias("piece", "s")).selectExpr("id", "piece", "s.a.x as x0", "s.a.y as y0", "s.b.x as x1", "s.b.y as y1").filter("not (x0 = x1 and y0 = y1)")


# --- roll-ups ---------------------------------------------------------------------------


def tile_rollup(df: DataFrame, r0: int = 13, step: int = 3) -> DataFrame:
    """(level, stateid, code, population): sums by Morton tile, coarser level by level.

    Takes stateid, code (at zoom ``r0``) and population. Each level is summed from the one
    below, so a state of very many blocks is reduced tile by tile. It ends at zoom 0 or when
    one tile is left.
    """
    level = stash(df.groupBy("stateid", "code").agg(F.sum("population").cast("long").alias("population")), "tiles")
    out, r = level.withColumn("level", F.lit(r0)), r0
    while r > 0 and level.select("code").distinct().limit(2).count() > 1:
        level = stash(level.groupBy("stateid", F.shiftright("code", 2 * step).alias("code")).agg(F.sum("population").alias("population")), "tiles")
        r = max(r - step, 0)
        out = out.unionByName(level.withColumn("level", F.lit(r)))
    return out.select("level", "stateid", "code", "population")


# --- areas -----------------------------------------------------------------------------


def _plain_box() -> Column:
    """Whether a ring is just its box: five points on the corners that enclose all of it."""
    corner = lambda p: ((p["x"] == F.col("minx")) | (p["x"] == F.col("maxx"))) & ((p["y"] == F.col("miny")) | (p["y"] == F.col("maxy")))
    whole = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return (F.size("ring") == 5) & F.forall("ring", corner) & (F.abs(ring_area(F.col("ring")) - whole) <= 1e-9 * whole)


def overlap_area(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """Pairs of simple polygons of any shape that overlap, with the area of their
    intersection. Takes id, ring and box columns; returns id0, id1, area (> 0).

    Rings that are boxes are not sent through the join, and two boxes meet by arithmetic
    alone; other pairs are clipped in vectorized tasks.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    bare = lambda df: df.select("id", *box, F.when(~_plain_box(), F.col("ring")).alias("ring"))
    met = bbox_join(bare(a), bare(b), tile, touching=False)
    shaped = F.col("ring0").isNotNull() | F.col("ring1").isNotNull()
    corners = [F.when(shaped, F.array(*(c + k for c in box))).alias(f"box{k}") for k in "01"]
    across = F.expr("(least(maxx0, maxx1) - greatest(minx0, minx1)) * (least(maxy0, maxy1) - greatest(miny0, miny1))")

    def area(r0: pd.Series, r1: pd.Series, b0: pd.Series, b1: pd.Series, id1: pd.Series) -> pd.Series:
        out, windows = np.zeros(len(r0)), {}

        def corners_of(ring: list | None, box: list) -> np.ndarray:
            if ring is not None:
                return points(ring)
            x0, y0, x1, y1 = box
            return np.array([(x0, y0), (x0, y1), (x1, y1), (x1, y0)], float)

        for k in np.flatnonzero(b0.notna().to_numpy()):
            if id1[k] not in windows:
                windows[id1[k]] = Window2D(corners_of(r1[k], b1[k]))
            out[k] = windows[id1[k]].common_area(corners_of(r0[k], b0[k]))
        return pd.Series(out)

    clipped = F.pandas_udf(area, "double")("ring0", "ring1", "box0", "box1", "id1")
    rows = met.select("id0", "id1", "ring0", "ring1", *corners, F.when(~shaped, across).alias("across")).withColumn("clipped", clipped)
    return rows.select("id0", "id1", F.coalesce("across", "clipped").alias("area")).filter("area > 0")


def assign_by_max_overlap(overlaps: DataFrame) -> DataFrame:
    """(blockid, wsid): the watershed of largest overlap, rounded to six places; ties to the
    smallest id."""
    best = overlaps.groupBy("blockid").agg(F.max(F.struct(F.round("area", 6).alias("area"), (-F.col("wsid")).alias("neg"))).alias("b"))
    return best.select("blockid", (-F.col("b.neg")).alias("wsid"))


# --- closing gaps ----------------------------------------------------------------------


def _ties_of_ends(active: DataFrame, tol: float) -> DataFrame:
    """(x0, y0, x1, y1): mutually nearest ends of different owners within ``tol``.

    All ends at one position are one row: its least id with the owner, and the least id of
    another owner, which stands in where the position is reached from its first owner's only.
    """
    ends = active.select("id", "owner", F.explode(F.expr("array(struct(x0 as x, y0 as y), struct(x1 as x, y1 as y))")).alias("p")).select("id", "owner", "p.x", "p.y")
    own = ends.filter("id is not null and owner is not null").groupBy("x", "y", "owner").agg(F.min("id").alias("id"))
    first = F.first("owner").over(Window.partitionBy("x", "y").orderBy("id", "owner"))
    spots = stash(own.withColumn("first", first).groupBy("x", "y").agg(F.min("id").alias("id"), F.min("first").alias("owner"), F.min(F.when(F.col("owner") != F.col("first"), F.col("id"))).alias("other")), "spots")
    reach, size = tol * (1 + 1e-9), 4 * tol
    cell = lambda c: F.floor(F.expr(c) / size)
    left = spots.selectExpr("x as x0", "y as y0", "if(other is null, owner, null) as only").withColumns({"_cx": cell("x0"), "_cy": cell("y0")})
    right = spots.selectExpr("x as x1", "y as y1", "id", "owner", "other")
    for c in "xy":
        right = right.withColumn(f"_c{c}", F.explode(F.sequence(cell(f"{c}1 - {reach}D"), cell(f"{c}1 + {reach}D"))))
    met = left.join(right, ["_cx", "_cy"]).withColumn("dist", planar_distance("x0", "y0", "x1", "y1")).filter(f"dist > 0 and dist <= {tol}D")
    pairs = met.selectExpr(*XY, "dist", "if(only = owner, other, id) as id1").filter("id1 is not null")
    ties = stash(mutual_nearest(pairs).select(*XY), "ties")
    discard(spots)
    return ties


def _ties_of_crossings(segments: DataFrame, active: DataFrame, tile: float, eps: float) -> DataFrame:
    """(x0, y0, x1, y1): the nearest ends of segments that cross or all but touch without a
    common end, and both ends of segments that several polygons run along the same way."""
    near = closest_endpoints(near_crossings(segments, tile, eps)).selectExpr("xa as x0", "ya as y0", "xb as x1", "yb as y1")
    doubled = retrace_map(active, "owner").filter("own_side > 1").select(*XY)
    either = near.unionByName(doubled).filter("not (x0 = x1 and y0 = y1)")
    return either.selectExpr(*(f"if(x0 < x1 or (x0 = x1 and y0 < y1), {c}{k}, {c}{1 - k}) as {c}{k}" for k in (0, 1) for c in "xy")).distinct()


def _moves(ties: DataFrame) -> DataFrame:
    """(x, y, nx, ny): each tied point to the nearest middle of its ties; ties by position."""
    middle = "struct(pow(x1 - x0, 2) + pow(y1 - y0, 2) as d, (x0 + x1) / 2 as nx, (y0 + y1) / 2 as ny) as n"
    ends = ties.select(F.explode(F.expr("array(struct(x0 as x, y0 as y), struct(x1 as x, y1 as y))")).alias("p"), F.expr(middle))
    return ends.groupBy("p.x", "p.y").agg(F.min("n").alias("n")).select("x", "y", "n.nx", "n.ny")


def collapse_gaps(segments: DataFrame, tol: float, tile: float = 1.0, eps: float = 1e-5, rounds: int = 64) -> DataFrame:
    """(id, owner, x0, y0, x1, y1, finished): segments with the gaps between polygons closed.

    Takes (id, owner, ends) of doubles. Segments whose reverse is run by just one other polygon
    are finished and tie no ends any more. In each round mutually nearest ends of different
    owners within ``tol`` are tied; where there are none, the nearest ends of segments that
    cross without a common end, and the ends of segments that several polygons run along on
    one side. Tied ends move to their middle, all segments that use them follow, finished
    ones too, and segments of no length go. It ends when nothing is tied; ties that are
    still made after ``rounds`` are an error. ``tile`` is about a segment's length.
    """
    clean = segments.select("id", "owner", *XY).filter("not (x0 = x1 and y0 = y1)")

    def matched(df: DataFrame) -> DataFrame:
        whole = retrace_map(df.filter("not finished"), "owner").filter("finished").select(*XY, F.lit(True).alias("_whole"))
        return stash(df.join(whole, XY, "left").select("id", "owner", *XY, (F.col("finished") | F.col("_whole").isNotNull()).alias("finished")), "closed")

    now = matched(clean.withColumn("finished", F.lit(False)))
    for _ in range(rounds):
        active = now.filter("not finished")
        moves = stash(_moves(_ties_of_ends(active, tol)), "moves")
        if not moves.limit(1).count():
            discard(moves)
            moves = stash(_moves(_ties_of_crossings(now, active, tile, eps)), "moves")
        if not moves.limit(1).count():
            discard(moves)
            return now
        moved = now
        for k in ("0", "1"):
            m = moves.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), "nx", "ny")
            moved = moved.join(m, [f"x{k}", f"y{k}"], "left").withColumn(f"x{k}", F.coalesce("nx", f"x{k}")).withColumn(f"y{k}", F.coalesce("ny", f"y{k}")).drop("nx", "ny")
        old, now = now, matched(stash(moved.filter("not (x0 = x1 and y0 = y1)"), "moved"))
        discard(old, moves)
    raise RuntimeError(f"ends still move after {rounds} rounds")
