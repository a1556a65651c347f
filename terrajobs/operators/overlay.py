"""Overlay of polygons: common parts and differences as polygons, holes included.

Polygons are sets of directed edges with the inside on their right, (id, x0, y0, x1, y1).
Edges of both sides are cut where they meet, found by cells of the plane. Each piece then lies
inside, outside or on the outline of a polygon of the other side, and those that bound the
result are the darts of its rings. Whether a piece is inside is told by counting edges along a
path of two legs: along its cell's lower border by a running count over the polygon's edges
that cross this border, then straight up among the edges in the cell. So a polygon's edges are
never brought together, and neither are a ring's: rings are found by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrajobs.functions.rings import orient_clockwise
from terrajobs.operators.joins import bbox_join
from terrajobs.operators.ordering import with_dense_id
from terrajobs.operators.outlines import XY, outline_segments, ring_arrays, rings
from terrajobs.storage import stash

_SHIFT = 0.381966011250105  # of a cell; its borders then meet no corner of a regular drawing


def polygon_edges(polygons: DataFrame, id_col: str = "id", ring_col: str = "ring", holes_col: str | None = None) -> DataFrame:
    """(id, x0, y0, x1, y1): the edges of closed rings of any direction, the inside on the right."""
    around = [orient_clockwise(F.col(ring_col))]
    path = F.array(*around)
    if holes_col:
        path = F.concat(path, F.coalesce(F.transform(F.col(holes_col), lambda h: F.reverse(orient_clockwise(h))), F.expr("array()").cast("array<array<struct<x:double,y:double>>>")))
    rows = polygons.select(F.col(id_col).alias("id"), F.explode(path).alias("r")).filter("size(r) > 3")
    pairs = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = rows.select("id", F.explode(pairs).alias("s"))
    return edges.selectExpr("id", *(f"cast(s.{p}.{c} as double) + 0D as {c}{k}" for k, p in enumerate("ab") for c in "xy")).select("id", *XY).filter("not (x0 = x1 and y0 = y1)")


def _boxed(edges: DataFrame) -> DataFrame:
    return edges.selectExpr("*", "least(x0, x1) as minx", "least(y0, y1) as miny", "greatest(x0, x1) as maxx", "greatest(y0, y1) as maxy")


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def _meeting_points(a: DataFrame, b: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Points at which edges of each side are to be cut: (edge, x, y), the same for both.

    A corner within ``tile`` / 2**30 of an edge lies on it. Crossings are rounded to that grid,
    but for the coordinate of an upright or level edge, so equal crossings of several edges
    on one line are equal points.
    """
    met = bbox_join(_boxed(a), _boxed(b), tile)
    near = tile / 2**30
    far = {0: f"{near} * sqrt((x10 - x00) * (x10 - x00) + (y10 - y00) * (y10 - y00))", 1: f"{near} * sqrt((x11 - x01) * (x11 - x01) + (y11 - y01) * (y11 - y01))"}
    side = {f"_{k}{own}": _side(f"x0{own}", f"y0{own}", f"x1{own}", f"y1{own}", f"x{k}{1 - own}", f"y{k}{1 - own}") for own in (0, 1) for k in (0, 1)}  # of the other edge's ends
    met = met.selectExpr("*", *(f"if(abs({e}) <= {far[int(k[-1])]}, 0D, {e}) as {k}" for k, e in side.items()))
    share = "_01 / (_01 - _11)"
    at = lambda c: f"case when {c}00 = {c}10 then {c}00 when {c}01 = {c}11 then {c}01 else rint(({c}00 + ({c}10 - {c}00) * ({share})) / {near}) * {near} end as {c}"
    crossing = f"if(_00 * _10 < 0 and _01 * _11 < 0, struct({at('x')}, {at('y')}), null)"
    beside = lambda c, k, own: f"{c}{k}{1 - own} between min{c}{own} - {near} and max{c}{own} + {near}"
    on = lambda k, own: f"if(_{k}{own} = 0 and {beside('x', k, own)} and {beside('y', k, own)}, struct(x{k}{1 - own} as x, y{k}{1 - own} as y), null)"
    met = stash(met.drop("_level"), "met")
    out = []
    for own in (0, 1):
        cuts = F.expr(f"filter(array({crossing}, {on(0, own)}, {on(1, own)}), p -> p is not null)")
        out.append(met.select(*(F.col(f"{c}{own}").alias(c) for c in ["id", *XY]), F.explode(cuts).alias("p")))
    return out[0], out[1]


def _cut(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges cut at their points, in order along them."""
    at = points.groupBy("id", *XY).agg(F.collect_set("p").alias("pts"))
    away = lambda p: (p["x"] - F.col("x0")) * (F.col("x1") - F.col("x0")) + (p["y"] - F.col("y0")) * (F.col("y1") - F.col("y0"))
    placed = F.transform(F.array_sort(F.transform("pts", lambda p: F.struct(away(p).alias("d"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = edges.join(at, ["id", *XY], "left").withColumn("pts", F.coalesce(placed, F.expr("array()").cast("array<struct<x:double,y:double>>")))
    path = F.concat(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))), "pts", F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    pairs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = rows.select("id", path.alias("path")).select("id", F.explode(pairs).alias("s"))
    return pieces.selectExpr("id", "s.a.x as x0", "s.a.y as y0", "s.b.x as x1", "s.b.y as y1").filter("not (x0 = x1 and y0 = y1)").distinct()


def noded(a: DataFrame, b: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Both sides' edges, cut wherever an edge of one meets an edge of the other."""
    at_a, at_b = _meeting_points(a, b, tile)
    return stash(_cut(a, at_a), "noded"), stash(_cut(b, at_b), "noded")


def _row(v: Column | str, tile: float) -> Column:
    return F.floor(((F.col(v) if isinstance(v, str) else v) - _SHIFT * tile) / tile)


def points_inside(points: DataFrame, edges: DataFrame, tile: float) -> DataFrame:
    """(the points' columns, inside): points (…, mx, my) with each polygon ``inside`` (an id of
    ``edges``) that they lie in. Points on a polygon's outline may count as in or out of it."""
    columns = points.columns
    spans = edges.groupBy("id").agg(F.min(F.least("x0", "x1")).alias("minx"), F.min(F.least("y0", "y1")).alias("miny"), F.max(F.greatest("x0", "x1")).alias("maxx"), F.max(F.greatest("y0", "y1")).alias("maxy"))
    dots = points.select(F.struct(*columns).alias("q"), F.col("mx").alias("minx"), F.col("my").alias("miny"), F.col("mx").alias("maxx"), F.col("my").alias("maxy"))
    asked = bbox_join(dots, spans, tile).select(F.col("q0").alias("q"), F.col("id1").alias("id"), F.col("minx0").alias("mx"), F.col("miny0").alias("my"))
    asked = asked.withColumn("r", _row("my", tile)).withColumn("c", _row("mx", tile))
    asked = stash(asked, "asked")

    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = F.when(_row(high, tile) > _row(low, tile), F.sequence(_row(low, tile) + 1, _row(high, tile)))
    line = (F.col("r") + F.lit(_SHIFT)) * tile
    crossed = edges.withColumn("r", F.explode(rows)).select("id", "r", (F.col("x0") + (line - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("at"), F.lit(1).alias("n"), F.lit(None).cast(asked.schema["q"].dataType).alias("q"))
    along = crossed.unionByName(asked.select("id", "r", F.col("mx").alias("at"), F.lit(0).alias("n"), "q"))
    so_far = F.sum("n").over(Window.partitionBy("id", "r").orderBy("at", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0))
    first = along.withColumn("legs", so_far).filter("n = 0").select("q", "id", F.col("legs").alias("n"))

    cells = edges.withColumn("r", F.explode(F.sequence(_row(low, tile), _row(high, tile)))).withColumn("c", F.explode(F.sequence(_row(F.least("x0", "x1"), tile), _row(F.greatest("x0", "x1"), tile))))
    height = "y0 + (mx - x0) * (y1 - y0) / (x1 - x0)"
    above = asked.join(cells, ["id", "r", "c"]).filter("(x0 > mx) <> (x1 > mx)").filter((F.expr(height) > line) & F.expr(f"{height} < my"))
    second = above.groupBy("q", "id").agg(F.count("*").alias("n"))
    odd = first.unionByName(second).groupBy("q", "id").agg(F.sum("n").alias("n")).filter("n % 2 = 1")
    return odd.select("q.*", F.col("id").alias("inside"))


def _middles(pieces: DataFrame) -> DataFrame:
    return pieces.selectExpr("*", "(x0 + x1) / 2 as mx", "(y0 + y1) / 2 as my")


def _classified(a: DataFrame, b: DataFrame, tile: float) -> tuple[DataFrame, ...]:
    """Pieces of a; of a in b, of b in a, on equal and on opposed edges, as (id0, id1, ends)."""
    pa, pb = noded(a, b, tile)
    left = pa.select(F.col("id").alias("id0"), *XY)
    equal = stash(left.join(pb.select(F.col("id").alias("id1"), *XY), XY), "equal").select("id0", "id1", *XY)
    opposed = stash(left.join(pb.select(F.col("id").alias("id1"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")), XY), "opposed").select("id0", "id1", *XY)
    turned = opposed.selectExpr("id0", "id1", "x1 as x0", "y1 as y0", "x0 as x1", "y0 as y1")
    on_outline = lambda other: equal.unionByName(other)
    a_in = points_inside(_middles(pa), b, tile).selectExpr("id as id0", "inside as id1", *XY).join(on_outline(opposed), ["id0", "id1", *XY], "left_anti")
    b_in = points_inside(_middles(pb), a, tile).selectExpr("inside as id0", "id as id1", *XY).join(on_outline(turned), ["id0", "id1", *XY], "left_anti")
    return left, stash(a_in, "inside"), stash(b_in, "inside"), equal, opposed


def common_edges(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(id0, id1, ends): edges of the common part of each pair of polygons of a and b."""
    _, a_in, b_in, equal, _ = _classified(a, b, tile)
    return a_in.unionByName(b_in).unionByName(equal)


def rest_edges(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(id, ends): edges of what is left of a's polygons without all of b's, which may touch one
    another but not overlap."""
    left, a_in, b_in, equal, _ = _classified(a, b, tile)
    gone = a_in.select("id0", *XY).unionByName(equal.select("id0", *XY)).distinct()
    turned = b_in.selectExpr("id0", "x1 as x0", "y1 as y0", "x0 as x1", "y0 as y1")
    return outline_segments(left.join(gone, ["id0", *XY], "left_anti").unionByName(turned), ["id0"]).withColumnRenamed("id0", "id")


def _without_straight(points: str = "points") -> Column:
    """A closed ring without points on a straight line between their neighbours, which cuts leave."""
    bare = F.slice(points, 1, F.size(points) - 1)
    at = lambda k: F.get(points, (k + F.size(points) - 1) % (F.size(points) - 1))

    def turns(p: Column, i: Column) -> Column:
        a, b = at(i - 1), at(i + 1)
        ux, uy, vx, vy = p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]
        return F.abs(ux * vy - uy * vx) > 1e-9 * (F.abs(ux) + F.abs(uy)) * (F.abs(vx) + F.abs(vy))

    kept = F.filter(bare, turns)
    return F.concat(kept, F.slice(kept, 1, 1))


def assembled(edges: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """(keys, part, ring, holes, area): a row per polygon that directed edges bound, numbered
    serially by its outer ring; points on straight lines are left out. A hole goes to the smallest outer ring of its keys around it."""
    found = rings(edges, keys)
    arrays = stash(ring_arrays(found, keys), "arrays").withColumn("points", _without_straight())
    shells = arrays.filter("area < 0").select(*keys, F.col("ring").alias("part"), F.col("points").alias("ring"), (-F.col("area")).alias("size"))
    inner = arrays.filter("area > 0").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("ring").alias("hole"), "points", F.col("area").alias("cut"))
    if not inner.limit(1).count():
        return shells.select(*keys, "part", "ring", F.expr("cast(array() as array<array<struct<x:double,y:double>>>)").alias("holes"), F.col("size").alias("area"))
    shell_edges = found.join(shells.select(F.col("part").alias("ring")), "ring", "left_semi").select(F.col("ring").alias("id"), *XY)
    dots = _middles(found.filter("ordinal = 0").join(inner.select(F.col("hole").alias("ring")), "ring", "left_semi").select(F.col("ring").alias("hole"), *XY)).select("hole", "mx", "my")
    around = points_inside(dots, shell_edges, tile).select("hole", F.col("inside").alias("part")).join(shells.drop("ring"), "part").join(inner, "hole")
    around = around.filter(" and ".join(f"{k} <=> _{k}" for k in keys))
    placed = around.groupBy("hole").agg(F.min_by(F.struct("part", "points", "cut"), F.struct("size", "part")).alias("h"))
    grouped = placed.groupBy("h.part").agg(F.transform(F.sort_array(F.collect_list(F.struct("hole", "h.points"))), lambda h: h["points"]).alias("holes"), F.sum("h.cut").alias("cut"))
    none = F.expr("cast(array() as array<array<struct<x:double,y:double>>>)")
    return shells.join(grouped, "part", "left").select(*keys, "part", "ring", F.coalesce("holes", none).alias("holes"), (F.col("size") - F.coalesce("cut", F.lit(0.0))).alias("area"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    return with_dense_id(rows, order, "newid")


def chop_by_region(polys: DataFrame, regions: DataFrame, tile: float) -> DataFrame:
    """(newid, id, stateid, region, ring, holes, area): the pieces of each polygon in each region.

    Takes polygons (id, ring) and regions (id, stateid, ring) of any simple shape, and
    optionally ``holes``, an array of rings, on either side. A polygon that a region cuts
    apart gives a row for each piece; parts that touch it in a line or a point only give none.
    ``newid`` is serial by id, region and piece. A null or degenerate ring has no pieces.
    """
    holes = lambda df: "holes" if "holes" in df.columns else None
    a, b = stash(polygon_edges(polys, holes_col=holes(polys)), "edges"), stash(polygon_edges(regions, holes_col=holes(regions)), "edges")
    pieces = assembled(common_edges(a, b, tile), ["id0", "id1"], tile)
    states = regions.select(F.col("id").alias("id1"), "stateid").distinct()
    rows = pieces.join(states, "id1").select(F.col("id0").alias("id"), "stateid", F.col("id1").alias("region"), "part", "ring", "holes", "area")
    return _numbered(rows, ["id", "region", "part"]).drop("part")


def mask_by_coast(ws: DataFrame, water: DataFrame, land: DataFrame, tile: float) -> DataFrame:
    """(id, part, ring, holes, area): polygons without the water, those on the border within the land.

    Takes ws (id, ring, border), water (id, ring) and land (id, ring). What water covers goes
    from every polygon. Of polygons marked ``border`` only what lies on land stays after that;
    pieces in different land polygons stay apart. A polygon of which nothing is left has one
    row with part 0, no ring and area 0. Waters must not overlap one another.
    """
    own, wet, dry = (stash(polygon_edges(df), "edges") for df in (ws, water, land))
    left = stash(rest_edges(own, wet, tile), "rest")
    border = ws.filter("border").select("id")
    at_home = left.join(border, "id", "left_semi")
    kept = common_edges(stash(at_home, "border"), dry, tile).select(F.col("id0").alias("id"), F.col("id1").alias("region"), *XY)
    inland = left.join(border, "id", "left_anti").select("id", F.lit(None).cast(kept.schema["region"].dataType).alias("region"), *XY)
    pieces = stash(assembled(kept.unionByName(inland), ["id", "region"], tile).drop("region"), "masked")
    empty = ws.select("id").distinct().join(pieces, "id", "left_anti")
    ring = pieces.schema["ring"].dataType
    return pieces.unionByName(empty.select("id", F.lit(0).cast("long").alias("part"), F.lit(None).cast(ring).alias("ring"), F.expr("cast(array() as array<array<struct<x:double,y:double>>>)").alias("holes"), F.lit(0.0).alias("area")))
