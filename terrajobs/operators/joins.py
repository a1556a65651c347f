"""Equi joins on exact coordinates, and range joins through grid cells.

A range join puts one side into its grid cell and the other into every cell its reach
touches, joins on the cell and filters exactly. A pair met in several cells is taken in one
of them only (its reference cell), so no distinct is needed. Cells are plain join keys:
adaptive execution splits a crowded one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrajobs.functions.polygons import common_area, points, signed_area
from terrajobs.functions.scalars import closest_point_on_segment, planar_distance, segment_distance, segment_intersection
from terrajobs.operators.nearest import nearest
from terrajobs.operators.ordering import best_per
from terrajobs.storage import discard, stash


def _cell(v: Column | str, size: float) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v / size).cast("long")


def renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([F.col(c).alias(c + suffix) for c in df.columns])


# --- exact coordinates -----------------------------------------------------------------


def match_reversed_segments(segments: DataFrame, owner: str = "wsid", state: str = "stateid", outside: int = 0) -> DataFrame:
    """Add ``neighbor``: the owner of the same segment run backwards in the same state, or
    ``outside``."""
    back = segments.select(F.col(owner).alias("_n"), F.col("x1").alias("_x0"), F.col("y1").alias("_y0"), F.col("x0").alias("_x1"), F.col("y0").alias("_y1"), F.col(state).alias("_s"))
    same = (F.col("x0") == F.col("_x0")) & (F.col("y0") == F.col("_y0")) & (F.col("x1") == F.col("_x1")) & (F.col("y1") == F.col("_y1")) & (F.col(state) == F.col("_s"))
    return segments.join(back, same, "left").withColumn("neighbor", F.coalesce("_n", F.lit(outside))).drop("_n", "_x0", "_y0", "_x1", "_y1", "_s")


def unmatched_segments(segments: DataFrame, owner: str = "wsid") -> DataFrame:
    """Segments of positive length without a reversed twin in another polygon."""
    back = segments.select(F.col(owner).alias("_n"), F.col("x1").alias("_x0"), F.col("y1").alias("_y0"), F.col("x0").alias("_x1"), F.col("y0").alias("_y1"))
    same = (F.col("x0") == F.col("_x0")) & (F.col("y0") == F.col("_y0")) & (F.col("x1") == F.col("_x1")) & (F.col("y1") == F.col("_y1")) & (F.col(owner) != F.col("_n"))
    return segments.filter("not (x0 = x1 and y0 = y1)").join(back, same, "left_anti")


def distinct_endpoints(segments: DataFrame) -> DataFrame:
    """(x, y) of both ends of all segments, each once."""
    return segments.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("p.x", "p.y").distinct()


def points_on_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points that are an end of some segment."""
    return points.join(distinct_endpoints(segments), ["x", "y"], "left_semi")


def border_members(blocks_points: DataFrame, border_points: DataFrame) -> DataFrame:
    """(blockid) with a vertex equal to a border vertex of their own state."""
    return blocks_points.join(border_points, ["stateid", "x", "y"], "left_semi").select("blockid").distinct()


def segments_on_outline(segments: DataFrame, outline: DataFrame) -> DataFrame:
    """Segments equal to one of the outline's in either direction, each once."""
    either = outline.select("x0", "y0", "x1", "y1").union(outline.select("x1", "y1", "x0", "y0")).distinct()
    return segments.join(either, ["x0", "y0", "x1", "y1"], "left_semi")


# --- range joins -----------------------------------------------------------------------


def within_distance(a: DataFrame, b: DataFrame, d: float, distinct_owner: bool = True, positive: bool = False, distinct_id: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Ordered pairs of points (id, owner, x, y) at most ``d`` apart, with ``dist``. Ids of two
    kinds may be equal (``distinct_id``); ``keep`` names more columns of ``a``."""
    left = renamed(a.select("id", "owner", "x", "y", *(keep or [])), "0").withColumn("_cx", _cell("x0", d)).withColumn("_cy", _cell("y0", d))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    right = renamed(b.select("id", "owner", "x", "y"), "1").withColumn("_dx", near).withColumn("_dy", near)
    right = right.withColumn("_cx", _cell("x1", d) + F.col("_dx")).withColumn("_cy", _cell("y1", d) + F.col("_dy")).drop("_dx", "_dy")
    pairs = left.join(right, ["_cx", "_cy"]).withColumn("dist", planar_distance("x0", "y0", "x1", "y1")).filter(F.col("dist") <= d)
    if distinct_id:
        pairs = pairs.filter("id0 <> id1")
    if distinct_owner:
        pairs = pairs.filter("owner0 <> owner1")
    if positive:
        pairs = pairs.filter("dist > 0")
    return pairs.drop("_cx", "_cy")


HALVINGS = 16  # of the reach, down to the least radius that is tried
FEW = 32  # pairs a point that the first radius may meet


def _first_halving(a: DataFrame, b: DataFrame, d: float) -> int:
    """How often to halve ``d`` until points meet few others, by counts of cells."""
    fine = d / (1 << HALVINGS)
    count = lambda df, k: df.groupBy(_cell("x", fine).alias("cx"), _cell("y", fine).alias("cy")).agg(F.count("*").alias("n")).selectExpr("cx", "cy", *(f"{'n' if j == k else '0L'} as n{j}" for j in (0, 1)))
    up = count(a, 0).unionByName(count(b, 1)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))))
    cells = up.groupBy("k", F.expr(f"shiftright(cx, {HALVINGS} - k)").alias("cx"), F.expr(f"shiftright(cy, {HALVINGS} - k)").alias("cy")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    met = cells.groupBy("k").agg((9 * F.sum(F.col("n0").cast("double") * F.col("n1"))).alias("met"), F.sum("n0").alias("n")).collect()
    return min((r.k for r in met if r.met <= FEW * max(r.n, 1)), default=HALVINGS)


def nearest_pairs(a: DataFrame, b: DataFrame, d: float, per: list[str], distinct_owner: bool = True, distinct_id: bool = True) -> DataFrame:
    """Of the pairs of ``within_distance`` those of least distance for each ``per``, all of equal
    distance: the rows that can be first by distance and whatever else.

    ``per`` are columns of the left side (id0, owner0, x0, y0). Pairs are first sought within a
    radius that few lie in. A key that has one there has its nearest there too; the left points
    of all others go on with twice the radius, up to ``d``. Least distances are aggregated
    without sorting, and only then pairs at that distance are made. Where points without a
    near partner lie beside a crowd, up to as many pairs are met as ``within_distance`` has.
    """
    rest, out, own = a.select("id", "owner", "x", "y"), None, [c[:-1] for c in per]
    b = b.select("id", "owner", "x", "y")
    for k in range(_first_halving(rest, b, d), -1, -1):
        r = d / (1 << k)
        least = stash(within_distance(rest, b, r, distinct_owner, distinct_id=distinct_id).groupBy(*per).agg(F.min("dist").alias("_least")).toDF(*own, "_least"), "least")
        at_least = within_distance(rest.join(least, own), b, r, distinct_owner, distinct_id=distinct_id, keep=["_least"])
        found = stash(at_least.filter("dist = _least0").drop("_least0"), "nearest")
        out = found if out is None else out.unionByName(found)
        if k:
            old, rest = rest, stash(rest.join(least, own, "left_anti"), "rest")
            discard(old, least)
            if not rest.limit(1).count():
                break
    return out


def nearest_links(points: DataFrame, d: float) -> DataFrame:
    """Of the pairs of ``within_distance`` those of least distance for each pair of owners, in
    both directions, all of equal distance.

    As ``nearest_pairs``: owners that lie in cells side by side are paired first; those that
    have a link within the radius are done, the points of all others go on with twice it.
    """
    rest = points.select("id", "owner", "x", "y").filter("owner is not null")
    spots = rest.select("owner", _cell("x", d).alias("_cx"), _cell("y", d).alias("_cy")).distinct()
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    beside = spots.toDF("other", "_cx", "_cy").withColumn("_dx", step).withColumn("_dy", step).selectExpr("other", "_cx + _dx as _cx", "_cy + _dy as _cy")
    todo = stash(spots.join(beside, ["_cx", "_cy"]).filter("owner < other").select(F.col("owner").alias("_a"), F.col("other").alias("_b")).distinct(), "todo")
    pair, out, first = [F.least("owner0", "owner1").alias("_a"), F.greatest("owner0", "owner1").alias("_b")], None, True
    for k in range(_first_halving(rest, rest, d), -1, -1):
        r = d / (1 << k)
        pairs = within_distance(rest, rest, r).select("*", *pair)
        if not first:
            pairs = pairs.join(todo, ["_a", "_b"], "left_semi")
        least = stash(pairs.groupBy("_a", "_b").agg(F.min("dist").alias("_least")), "least")
        found = stash(pairs.join(least, ["_a", "_b"]).filter("dist = _least").drop("_a", "_b", "_least"), "links")
        out, first = found if out is None else out.unionByName(found), False
        todo = stash(todo.join(least, ["_a", "_b"], "left_anti"), "todo")
        if k:
            if not todo.limit(1).count():
                break
            left = todo.select(F.explode(F.array("_a", "_b")).alias("owner")).distinct()
            rest = stash(rest.join(left, "owner", "left_semi"), "rest")
    return out


def _in_cells(df: DataFrame, s: str, others: DataFrame, tile: float) -> DataFrame:
    """Boxes in the cells of their own size, and of those larger sizes that the other side has.

    ``_grid`` names the cells' size and who meets there: side 0's boxes of that size and all of
    side 1's, or its smaller boxes and only side 1's of that size, so two that are both too
    small never meet. ``_left`` and ``_low`` tell the box's first column and row of cells.
    """
    rows = renamed(df, s).withColumn(f"_own{s}", _level(s, tile)).join(F.broadcast(others), how="inner")
    levels = F.concat(F.array(f"_own{s}"), F.filter("_levels", lambda v: v > F.col(f"_own{s}")))
    rows = rows.withColumn("_level", F.explode(levels)).withColumn("_size", F.lit(tile) * F.pow(F.lit(2.0), F.col("_level")))
    first = lambda c: F.floor(F.col(f"{c}{s}") / F.col("_size"))
    rows = rows.withColumn("_tx", F.explode(F.sequence(first("minx"), first("maxx")))).withColumn("_ty", F.explode(F.sequence(first("miny"), first("maxy"))))
    rows = rows.withColumns({f"_left{s}": F.col("_tx") == first("minx"), f"_low{s}": F.col("_ty") == first("miny")})
    own, any_smaller = F.col("_level") == F.col(f"_own{s}"), F.exists("_levels", lambda v: v < F.col("_level"))
    all_of, smaller = F.col("_level") * 2, F.col("_level") * 2 + 1
    grid = F.array(F.when(own, all_of).otherwise(smaller)) if s == "0" else F.when(own & any_smaller, F.array(all_of, smaller)).otherwise(F.array(all_of))
    return rows.withColumn("_grid", F.explode(grid)).drop("_levels", "_level", "_size", f"_own{s}")


def _level(s: str, tile: float) -> Column:
    side = F.greatest(F.col(f"maxx{s}") - F.col(f"minx{s}"), F.col(f"maxy{s}") - F.col(f"miny{s}"))
    return F.when(side > tile, F.ceil(F.log2(side / tile) - 1e-9)).otherwise(0).cast("int")  # a side of the cell's size but for rounding stays there


def bbox_join(a: DataFrame, b: DataFrame, tile: float, touching: bool = True) -> DataFrame:
    """Pairs whose boxes (minx, miny, maxx, maxy) meet; columns get suffixes 0 and 1.

    Cells double from ``tile`` up. A box lies in at most four cells of the level of its size,
    and is looked up in as many of each larger level in use, so a box that covers the whole
    plane costs no more than a small one. A pair meets at the level of its larger box, in
    the cell of the lower left corner of the boxes' overlap.
    """
    used = lambda df, s: renamed(df.select("minx", "miny", "maxx", "maxy"), s).agg(F.collect_set(_level(s, tile)).alias("_levels"))
    left, right = _in_cells(a, "0", used(b, "1"), tile), _in_cells(b, "1", used(a, "0"), tile)
    op = "<=" if touching else "<"
    meet = F.expr(f"minx0 {op} maxx1 and minx1 {op} maxx0 and miny0 {op} maxy1 and miny1 {op} maxy0 and (_left0 or _left1) and (_low0 or _low1)")
    return left.join(right, ["_grid", "_tx", "_ty"]).filter(meet).drop("_grid", "_tx", "_ty", "_left0", "_left1", "_low0", "_low1")


def _segment_boxes(segments: DataFrame, margin: float) -> DataFrame:
    return segments.selectExpr("*", f"least(x0, x1) - {margin} as minx", f"least(y0, y1) - {margin} as miny", f"greatest(x0, x1) + {margin} as maxx", f"greatest(y0, y1) + {margin} as maxy")


def snap_candidates(segments: DataFrame, points: DataFrame, tol: float, end_tol: float, tile: float, other_owner: bool = True) -> DataFrame:
    """Points within ``tol`` of a segment and further than ``end_tol`` from both its ends.

    Takes segments (id, owner, x0, y0, x1, y1) and points (id, owner, x, y).
    """
    dots = points.selectExpr("id as pid", "owner as powner", "x", "y", "x as minx", "y as miny", "x as maxx", "y as maxy")
    lines = _segment_boxes(segments.select("id", "owner", "x0", "y0", "x1", "y1"), tol).withColumnsRenamed({"x0": "ax", "y0": "ay", "x1": "bx", "y1": "by"})
    met = bbox_join(lines, dots, tile).withColumn("near", closest_point_on_segment("x1", "y1", "ax0", "ay0", "bx0", "by0"))
    met = met.filter((F.col("near.dist") <= tol) & (planar_distance("x1", "y1", "ax0", "ay0") > end_tol) & (planar_distance("x1", "y1", "bx0", "by0") > end_tol))
    if other_owner:
        met = met.filter("owner0 <> powner1")
    return met.select(F.col("id0").alias("segid"), F.col("pid1").alias("pointid"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("near.dist").alias("dist"))


def segment_pairs(a: DataFrame, b: DataFrame, tile: float, margin: float = 0.0) -> DataFrame:
    """Pairs of segments (id, x0, y0, x1, y1) whose boxes meet, as a_id, ax0 … and b_id, bx0 …"""
    cols = {"id0": "a_id", "x00": "ax0", "y00": "ay0", "x10": "ax1", "y10": "ay1", "id1": "b_id", "x01": "bx0", "y01": "by0", "x11": "bx1", "y11": "by1"}
    keep = ["id", "x0", "y0", "x1", "y1"]
    met = bbox_join(_segment_boxes(a.select(keep), margin), _segment_boxes(b.select(keep), margin), tile)
    return met.select([F.col(k).alias(v) for k, v in cols.items()])


_A, _B = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")


def _then(df: DataFrame, condition: Column | str) -> DataFrame:
    """Filter in a step of its own. Conditions that Spark moves into a join make its loop too
    long for Java to compile, and many times slower: the partition's number, which Spark can't
    move, keeps this one out of the join below, and the coalesce, which merges nothing, out of
    its generated code."""
    return df.coalesce(1 << 20).filter((F.expr(condition) if isinstance(condition, str) else condition) == (F.spark_partition_id() >= 0))


def near_crossings(segments: DataFrame, tile: float, eps: float = 1e-5) -> DataFrame:
    """Segment pairs, once each, within ``eps`` of one another that share no end. Pairs of which
    one lies clear of the other's line go before distances are worked out."""
    apart = [f"not (a{p} = b{q} and a{p.replace('x', 'y')} = b{q.replace('x', 'y')})" for p in ("x0", "x1") for q in ("x0", "x1")]

    def close(one: str, other: str) -> str:
        side = [f"(({one}x1 - {one}x0) * ({other}y{k} - {one}y0) - ({one}y1 - {one}y0) * ({other}x{k} - {one}x0))" for k in (0, 1)]
        size = " + ".join(f"abs({c})" for c in (f"{one}x0", f"{one}y0", *(f"{other}{v}{k}" for v in "xy" for k in (0, 1))))
        reach = f"({2 * eps}D + 1e-12D * ({size})) * (abs({one}x1 - {one}x0) + abs({one}y1 - {one}y0))"
        return f"not (least({side[0]}, {side[1]}) > {reach} or greatest({side[0]}, {side[1]}) < -{reach})"

    met = segment_pairs(segments, segments, tile, eps).filter("a_id < b_id")
    met = _then(met, " and ".join([*apart, close("a", "b"), close("b", "a")]))
    return _then(met, segment_distance(_A, _B) <= eps)


def line_crossings(rivers: DataFrame, interfaces: DataFrame, tile: float) -> DataFrame:
    """(a_id, b_id, x, y): points where river segments cross interface segments."""
    return segment_pairs(rivers, interfaces, tile).withColumn("p", segment_intersection(_A, _B)).filter("p is not null").select("a_id", "b_id", "p.x", "p.y")


def contained_pairs(inner: DataFrame, outer: DataFrame, tile: float) -> DataFrame:
    """(id0, id1) of simple polygons 0 that lie wholly inside polygons 1, edges allowed: their
    common area is the inner one's, to a billionth.

    Takes id, ring and the box columns.
    """
    met = bbox_join(inner, outer, tile).filter("id0 <> id1 and minx0 >= minx1 and maxx0 <= maxx1 and miny0 >= miny1 and maxy0 <= maxy1")

    def within(r0: pd.Series, r1: pd.Series) -> pd.Series:
        pairs = [(points(p), points(q)) for p, q in zip(r0, r1, strict=True)]
        return pd.Series([common_area(p, q) >= abs(signed_area(p)) * (1 - 1e-9) for p, q in pairs], dtype=bool)

    return met.filter(F.pandas_udf(within, "boolean")("ring0", "ring1")).select("id0", "id1")


def drop_contained(polys: DataFrame, tile: float) -> DataFrame:
    """Polygons that lie within no other one; of equal ones the smallest id stays."""
    found = contained_pairs(polys, polys, tile)
    equal = found.join(found.selectExpr("id1 as id0", "id0 as id1"), ["id0", "id1"], "left_semi").filter("id0 < id1")
    gone = found.join(equal, ["id0", "id1"], "left_anti").select(F.col("id0").alias("id")).distinct()
    return polys.join(gone, "id", "left_anti")


def enclosing_many(shells: DataFrame, polys: DataFrame, tile: float) -> DataFrame:
    """(id, n): shells that hold more than one polygon."""
    return contained_pairs(polys, shells, tile).groupBy(F.col("id1").alias("id")).agg(F.count_distinct("id0").alias("n")).filter("n > 1")


def line_adjacency(segments: DataFrame, owner: str = "wsid", same_state: bool = True, tile: float = 1.0) -> DataFrame:
    """Ordered pairs of polygons with a common boundary of positive length.

    Boundaries need not have equal ends: segments whose boxes meet are held against each
    other, and count if both ends of the one lie on the other's line, to a billionth of
    ``tile`` (about a segment's length), and they overlap along it. Rows grow with the
    segments, not with their lengths.
    """
    near = tile * 1e-9
    s = segments.filter("not (x0 = x1 and y0 = y1)").selectExpr(f"{owner} as w", "stateid as st", *(f"cast({c} as double) as {c}" for c in ("x0", "y0", "x1", "y1")))
    boxes = _segment_boxes(s, near)
    met = bbox_join(boxes, boxes, 1.37 * tile).filter("w0 <> w1")  # so that regular drawings do not lie on the cells' borders
    if same_state:
        met = met.filter("st0 = st1")
    dx, dy, size = "(x10 - x00)", "(y10 - y00)", "sqrt((x10 - x00) * (x10 - x00) + (y10 - y00) * (y10 - y00))"
    on_line = " and ".join(f"abs({dx} * (y{k}1 - y00) - {dy} * (x{k}1 - x00)) <= {near} * {size}" for k in (0, 1))
    along = [f"({dx} * (x{k}1 - x00) + {dy} * (y{k}1 - y00)) / {size}" for k in (0, 1)]
    overlap = f"least({size}, greatest({along[0]}, {along[1]})) - greatest(0D, least({along[0]}, {along[1]})) > {near}"
    return met.filter(f"{on_line} and {overlap}").select(F.col("w0").alias("id0"), F.col("w1").alias("id1")).distinct()


def nearest_within_passes(left: DataFrame, right: DataFrame, tols: list[float], same_state: bool = True) -> DataFrame:
    """(id, match, dist): each left point's nearest right point by (distance, id).

    Points are (id, stateid, x, y). Only distances up to the largest of ``tols`` count; passes
    of growing radius would find the same partners. Equal states are asked for unless the
    left side knows one state only. Points without a place or a needed state have no match.
    """
    if same_state:
        same_state = left.select("stateid").distinct().limit(2).count() > 1
    part = F.col("stateid") if same_state else F.lit(0)
    shaped = lambda df: df.select("id", part.alias("part"), F.lit(None).cast("long").alias("owner"), "x", "y")
    return nearest(shaped(left).withColumn("key", F.col("id")), shaped(right), max(tols)).select(F.col("key").alias("id"), "match", "dist")


def nearest_group(members: DataFrame, either_way: bool = False) -> DataFrame:
    """(groupid, other, id0, id1, dist): for each group the closest other group in its state.

    Takes (id, groupid, stateid, x, y). Ties go to the smaller group and then ids; with
    ``either_way`` to the pair of smaller ids, the same from both groups. A group
    alone in its state has no row, and members without a group, a state or a place count as
    absent.
    """
    rows = members.filter("groupid is not null").select(F.col("groupid").alias("key"), "id", F.col("stateid").alias("part"), F.col("groupid").alias("owner"), "x", "y")
    return nearest(rows, rows.drop("key"), either_way=either_way).select(F.col("key").alias("groupid"), F.col("owner").alias("other"), F.col("id").alias("id0"), F.col("match").alias("id1"), "dist")


def point_in_region(points: DataFrame, regions: DataFrame, tile: float) -> DataFrame:
    """(pointid, regionid): the region (id, stateid, ring, box) of the same state that holds
    each point (id, stateid, x, y); the smallest id if several do."""
    from terrajobs.functions.rings import contains_point

    dots = points.selectExpr("id", "stateid", "x as minx", "y as miny", "x as maxx", "y as maxy")
    met = bbox_join(dots, regions, tile).filter("stateid0 = stateid1").filter(contains_point(F.col("ring1"), F.col("minx0"), F.col("miny0")))
    return met.groupBy(F.col("id0").alias("pointid")).agg(F.min("id1").alias("regionid"))


# --- attribute joins -------------------------------------------------------------------


def possible_descents(ws: DataFrame, raw: DataFrame, connections: DataFrame) -> DataFrame:
    """(id, parent, connectionids): where the source's flow link is also an adjacency; parent 0
    with the interfaces that face outside. Takes ws (id, externalid), raw (id, parentid) and
    connections (wsid0, wsid1, connectionid)."""
    up = ws.select(F.col("id").alias("pid"), F.col("externalid").alias("pext"))
    linked = ws.join(raw.select(F.col("id").alias("externalid"), F.col("parentid").alias("pext")), "externalid").join(up, "pext")
    inside = linked.join(connections, (F.col("id") == F.col("wsid0")) & (F.col("pid") == F.col("wsid1"))).groupBy("id", F.col("pid").alias("parent")).agg(F.sort_array(F.collect_list("connectionid")).alias("connectionids"))
    outside = connections.filter("wsid1 = 0").groupBy(F.col("wsid0").alias("id"), F.lit(0).cast("long").alias("parent")).agg(F.sort_array(F.collect_list("connectionid")).alias("connectionids"))
    return inside.unionByName(outside)


def neighbor_crossings(ws: DataFrame, raw: DataFrame, connections: DataFrame, crossings: DataFrame, solved: DataFrame) -> DataFrame:
    """(id, parent, via, x, y): for a child without an exit, the crossings into neighbours
    common to it and its parent. Crossings are (wsid0, wsid1, x, y)."""
    up = ws.select(F.col("id").alias("parent"), F.col("externalid").alias("pext"))
    open_ = ws.join(solved.select("id"), "id", "left_anti").join(raw.select(F.col("id").alias("externalid"), F.col("parentid").alias("pext")), "externalid").join(up, "pext").select("id", "parent")
    mine = connections.select(F.col("wsid0").alias("id"), F.col("wsid1").alias("via")).filter("via <> 0").distinct()
    theirs = connections.select(F.col("wsid0").alias("parent"), F.col("wsid1").alias("via")).distinct()
    cross = crossings.select(F.col("wsid0").alias("id"), F.col("wsid1").alias("via"), "x", "y")
    return open_.join(mine, "id").join(theirs, ["parent", "via"], "left_semi").join(cross, ["id", "via"]).select("id", "parent", "via", "x", "y")


def detached_children(ws: DataFrame, raw: DataFrame, connections: DataFrame) -> DataFrame:
    """(id): polygons not on the boundary that touch none of their possible parents."""
    up = ws.select(F.col("id").alias("pid"), F.col("externalid").alias("pext"))
    linked = ws.filter("not boundary").join(raw.select(F.col("id").alias("externalid"), F.col("parentid").alias("pext")), "externalid").join(up, "pext")
    met = linked.join(connections.select("wsid0", "wsid1").distinct(), (F.col("id") == F.col("wsid0")) & (F.col("pid") == F.col("wsid1")), "left")
    return met.groupBy("id").agg(F.count("wsid1").alias("n")).filter("n = 0").select("id")


def unfinished_regions(groups: DataFrame) -> DataFrame:
    """Rows (stateid, groupid, …) of states that still have more than one group."""
    many = groups.groupBy("stateid").agg(F.count_distinct("groupid").alias("_n")).filter("_n > 1").select("stateid")
    return groups.join(many, "stateid", "left_semi")


def block_network(connections: DataFrame, islands: DataFrame, blocks: DataFrame) -> DataFrame:
    """(stateid, blockid0, blockid1): both edge tables, both ends in one state."""
    pairs = connections.select("blockid0", "blockid1").union(islands.select("blockid0", "blockid1")).distinct()
    ends = lambda k: blocks.select(F.col("blockid").alias(f"blockid{k}"), F.col("stateid").alias(f"s{k}"))
    return pairs.join(ends(0), "blockid0").join(ends(1), "blockid1").filter("s0 = s1").select(F.col("s0").alias("stateid"), "blockid0", "blockid1")


def backfill(df: DataFrame, updates: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Overwrite the updates' columns where the key matches, keep the others, fill nulls."""
    new = [c for c in updates.columns if c != key]
    joined = df.join(renamed(updates.select(key, *new), "_new").withColumnRenamed(f"{key}_new", key), key, "left")
    for c in new:
        joined = joined.withColumn(c, F.coalesce(F.col(f"{c}_new"), *([F.col(c)] if c in df.columns else [])))
        if defaults and c in defaults:
            joined = joined.withColumn(c, F.coalesce(c, F.lit(defaults[c])))
    return joined.drop(*[f"{c}_new" for c in new])


def pair_first_appearance(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, rank) that rank first for both members, in whichever place they stand."""
    first = pairs.groupBy(F.col("a").alias("id")).agg(F.min("rank").alias("ra"))
    second = pairs.groupBy(F.col("b").alias("id")).agg(F.min("rank").alias("rb"))
    best = first.join(second, "id", "full_outer").select("id", F.least("ra", "rb").alias("rank"))
    both = best.groupBy("rank").agg(F.count("*").alias("n")).filter("n = 2").select("rank")
    return pairs.join(both, "rank", "left_semi")


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Reciprocal nearest pairs of points, once each; takes id0, id1, x0, y0, x1, y1, dist.

    Nearest by (distance, id); a position's candidates are those of all points there.
    """
    best = best_per(pairs, ["x0", "y0"], ["dist", "id1"])
    other = best.select(F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("x0"), F.col("y1").alias("y0"))
    return best.join(other, ["x0", "y0", "x1", "y1"], "left_semi").filter("x0 < x1 or (x0 = x1 and y0 <= y1)")
