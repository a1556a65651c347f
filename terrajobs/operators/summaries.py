"""Grouped sums, centroids, ties, set operations and consistency checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrajobs.functions.rings import closest_point_on_ring, contains_point
from terrajobs.functions.scalars import planar_distance
from terrajobs.operators.joins import nearest_pairs
from terrajobs.operators.ordering import best_per, running_sum
from terrajobs.operators.outlines import XY, outline_segments, rings
from terrajobs.storage import stash


def state_population(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("stateid").agg(F.sum("population").cast("long").alias("population"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def interface_lengths(connections: DataFrame, exits: DataFrame, island_links: DataFrame | None = None, rings: DataFrame | None = None, distance: Callable[..., Column] = planar_distance) -> DataFrame:
    """(wsid0, wsid1, length, exitdist) in both directions of every pair.

    Lengths of all interfaces of a pair are summed; exitdist lies between the two exit
    points (id, x, y); island links have length and exitdist 0. With ``rings`` (id, basinid,
    ring) there is also ``outside``: from wsid0's exit to the closest point of wsid1's
    polygon if that is in another basin, else 0. ``distance`` measures between two points,
    ``geo_distance`` for longitudes and latitudes.
    """
    inside = connections.filter("wsid1 <> 0").groupBy(F.least("wsid0", "wsid1").alias("a"), F.greatest("wsid0", "wsid1").alias("b")).agg((F.sum("length") / 2).alias("length")).withColumn("island", F.lit(False))
    if island_links is not None:
        inside = inside.unionByName(island_links.select(F.least("wsid0", "wsid1").alias("a"), F.greatest("wsid0", "wsid1").alias("b"), F.lit(0.0).alias("length"), F.lit(True).alias("island")).distinct())
    end = lambda k, c: exits.select(F.col("id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    rows = inside.join(end(0, "a"), "a").join(end(1, "b"), "b").select("a", "b", "length", F.when(F.col("island"), 0.0).otherwise(distance("x0", "y0", "x1", "y1")).alias("exitdist"))
    both = rows.selectExpr("a as wsid0", "b as wsid1", "length", "exitdist").union(rows.selectExpr("b", "a", "length", "exitdist"))
    if rings is None:
        return both
    own = exits.select(F.col("id").alias("wsid0"), F.col("x").alias("ex"), F.col("y").alias("ey")).join(rings.select(F.col("id").alias("wsid0"), F.col("basinid").alias("basin0")), "wsid0")
    met = both.join(own, "wsid0").join(rings.select(F.col("id").alias("wsid1"), F.col("basinid").alias("basin1"), "ring"), "wsid1")
    near = closest_point_on_ring("ex", "ey", F.col("ring"))
    away = F.when((F.col("basin0") == F.col("basin1")) | contains_point(F.col("ring"), F.col("ex"), F.col("ey")), 0.0).otherwise(distance("ex", "ey", near["x"], near["y"]))
    return met.select("wsid0", "wsid1", "length", "exitdist", away.alias("outside"))


def island_areas(ws: DataFrame) -> DataFrame:
    return ws.groupBy("islandid").agg(F.sum("area").alias("area"))


def watershed_population(mapping: DataFrame, blocks: DataFrame, ws: DataFrame) -> DataFrame:
    """(wsid, population): summed over mapped blocks, 0 without any."""
    sums = mapping.join(blocks.select("blockid", "population"), "blockid").groupBy("wsid").agg(F.sum("population").cast("long").alias("population"))
    return ws.select("wsid").join(sums, "wsid", "left").select("wsid", F.coalesce("population", F.lit(0)).cast("long").alias("population"))


def collected_centroid(df: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid per group of (dimension, weight, x, y): only the highest dimension counts;
    points weigh 1, lines their length."""
    top = df.groupBy(*keys, "dimension").agg(F.sum(F.col("weight") * F.col("x")).alias("sx"), F.sum(F.col("weight") * F.col("y")).alias("sy"), F.sum("weight").alias("sw"))
    best = top.groupBy(*keys).agg(F.max_by(F.struct("sx", "sy", "sw"), "dimension").alias("s"))
    return best.select(*keys, (F.col("s.sx") / F.col("s.sw")).alias("x"), (F.col("s.sy") / F.col("s.sw")).alias("y"))


def weighted_centroid(df: DataFrame, keys: list[str], weight: str = "area") -> DataFrame:
    w = F.sum(weight)
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col("x")) / w).alias("x"), (F.sum(F.col(weight) * F.col("y")) / w).alias("y"))


def max_move(moves: DataFrame) -> DataFrame:
    """One row: the largest distance with a hundredth added."""
    return moves.agg((F.max("dist") * 1.01).alias("tolerance"))


def district_summary(assignment: DataFrame, blocks: DataFrame) -> DataFrame:
    return assignment.join(blocks.select("blockid", "stateid", "population"), "blockid").groupBy("stateid", "districtid").agg(F.sum("population").cast("long").alias("population"), F.count("*").alias("blocks"))


def district_outlines(assignment: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """``district_summary`` with the segments of each district's outline (x0, y0, x1, y1), in
    order along its rings (ring, ordinal). Takes the blocks' directed segments (blockid, ends)."""
    keys = ["stateid", "districtid"]
    owned = segments.select("blockid", *XY).join(assignment.select("blockid", "districtid"), "blockid").join(blocks.select("blockid", "stateid"), "blockid")
    return rings(outline_segments(owned.select(*keys, *XY), keys), keys).join(district_summary(assignment, blocks), keys)


def basin_outlines(ws: DataFrame, segments: DataFrame) -> DataFrame:
    """``basin_summary`` with the segments of each basin's outline, as in ``district_outlines``.
    Takes the watersheds' directed segments (id, ends)."""
    keys = ["stateid", "basinid"]
    owned = segments.select("id", *XY).join(ws.select("id", *keys), "id")
    return rings(outline_segments(owned.select(*keys, *XY), keys), keys).join(basin_summary(ws), keys)


def basin_summary(ws: DataFrame) -> DataFrame:
    return ws.groupBy("stateid", "basinid").agg(F.sum("population").cast("long").alias("population"), F.count("*").alias("watersheds"))


def region_table(states: DataFrame, tally: DataFrame, reps: DataFrame) -> DataFrame:
    return states.join(tally.select("stateid", "name"), "stateid").join(reps.select(F.col("state").alias("name"), "representatives"), "name").select("stateid", "name", "population", "representatives")


def consistency_report(blocks: DataFrame, segments: DataFrame, edges: DataFrame, mapping: DataFrame, ws: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """(check, failures): 0 where a table is consistent. ``connections`` are interfaces (wsid0,
    wsid1, connectionid): one has two sides at most, and a polygon has it once."""
    checks = {
        "block ids are unique": blocks.agg(F.count("*") - F.count_distinct("blockid")),
        "adjacency is unique": edges.agg(F.count("*") - F.count_distinct("blockid0", "blockid1")),
        "adjacency is mutual": edges.join(edges.selectExpr("blockid1 as blockid0", "blockid0 as blockid1"), ["blockid0", "blockid1"], "left_anti").agg(F.count("*")),
        "no self neighbour": edges.filter("blockid0 = blockid1").agg(F.count("*")),
        "no zero-length segment": segments.filter("x0 = x1 and y0 = y1").agg(F.count("*")),
        "all blocks mapped": blocks.join(mapping, "blockid", "left_anti").agg(F.count("*")),
        "population totals equal": blocks.agg(F.sum("population").alias("a")).join(ws.agg(F.sum("population").alias("b")), how="inner").select(F.abs(F.col("a") - F.col("b"))),
    }
    if connections is not None:
        checks["no interface more than twice"] = connections.groupBy("connectionid").agg(F.count("*").alias("n")).filter("n > 2").agg(F.count("*"))
        checks["interfaces of a polygon are unique"] = connections.agg(F.count("*") - F.count_distinct("wsid0", "connectionid"))
    out = None
    for name, one in checks.items():
        row = one.toDF("failures").select(F.lit(name).alias("check"), F.col("failures").cast("long").alias("failures"))
        out = row if out is None else out.unionByName(row)
    return out


# --- windows ---------------------------------------------------------------------------


def assign_nearest_tie(points: DataFrame, ties: DataFrame, tol: float) -> DataFrame:
    """(id, tieid, dist): each point's nearest tie centre (tieid, x, y) within ``tol``; ties by id."""
    owner = F.lit(None).cast("long").alias("owner")
    met = nearest_pairs(points.select("id", owner, "x", "y"), ties.select(F.col("tieid").alias("id"), owner, "x", "y"), tol, ["id0"], distinct_owner=False, distinct_id=False)
    return met.groupBy(F.col("id0").alias("id")).agg(F.min("dist").alias("dist"), F.min("id1").alias("tieid")).select("id", "tieid", "dist")


def closest_endpoints(pairs: DataFrame) -> DataFrame:
    """The nearest of the 2 x 2 end pairs of crossing segments (a_id, ax0 … by1)."""
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("ea"), F.lit(j).alias("eb"), F.col(f"ax{i}").alias("xa"), F.col(f"ay{i}").alias("ya"), F.col(f"bx{j}").alias("xb"), F.col(f"by{j}").alias("yb")) for i in (0, 1) for j in (0, 1)]))
    rows = pairs.select("a_id", "b_id", ends.alias("e")).select("a_id", "b_id", "e.*").withColumn("dist", planar_distance("xa", "ya", "xb", "yb"))
    return best_per(rows, ["a_id", "b_id"], ["dist", "ea", "eb"])


def nearest_interface(candidates: DataFrame) -> DataFrame:
    """One row per id: nearest, then the longer interface, then the smaller parent and interface."""
    return best_per(candidates, ["id"], ["dist", "-length", "parent", "connectionid"])


def closest_link_per_group(links: DataFrame) -> DataFrame:
    """Nearest foreign link of each island by distance, larger area, id."""
    return best_per(links, ["islandid0"], ["dist", "-area", "wsid1", "wsid0"])


def dedupe_links(links: DataFrame) -> DataFrame:
    """One link between two islands: nearest, then ids; links lacking their reverse go."""
    pair = [F.least("islandid0", "islandid1"), F.greatest("islandid0", "islandid1")]
    keyed = links.withColumn("_a", pair[0]).withColumn("_b", pair[1]).withColumn("_u", F.least("wsid0", "wsid1")).withColumn("_v", F.greatest("wsid0", "wsid1"))
    best = keyed.groupBy("_a", "_b").agg(F.min(F.struct("dist", "_u", "_v")).alias("m")).select("_a", "_b", "m._u", "m._v")
    kept = keyed.join(best, ["_a", "_b", "_u", "_v"], "left_semi").drop("_a", "_b", "_u", "_v")
    return drop_nonreciprocal(kept, "wsid0", "wsid1")


def longest_interface(connections: DataFrame) -> DataFrame:
    """One interface per (wsid0, wsid1): the longest, then the smallest id."""
    return best_per(connections, ["wsid0", "wsid1"], ["-length", "connectionid"])


def population_cut(blocks: DataFrame, key: str = "rootid") -> DataFrame:
    """Blocks in order of (score, id) up to the first whose taking would leave the running
    population strictly further from ``target``; equally far is taken. One key's blocks may
    lie in any number of tasks."""
    rows = stash(running_sum(blocks, [key], ["score", "blockid"], "population"), "running")
    before = F.col("running") - F.col("population")
    further = F.abs(F.col("running") - F.col("target")) > F.abs(before - F.col("target"))
    stop = rows.filter(further).groupBy(key).agg(F.min(F.struct("score", "blockid")).alias("_stop"))
    return rows.join(stop, key, "left").filter(F.col("_stop").isNull() | (F.struct("score", "blockid") < F.col("_stop"))).drop("_stop")


# --- sets ------------------------------------------------------------------------------


def symmetrize(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(src, dst).union(edges.select(dst, src)).distinct()


def stack(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def split_boundary_points(points: DataFrame, boundary: DataFrame, interior: DataFrame) -> DataFrame:
    """Points (x, y) with ``side``: boundary only, interior only or both; others go."""
    b, i = boundary.select("x", "y").distinct().withColumn("_b", F.lit(1)), interior.select("x", "y").distinct().withColumn("_i", F.lit(1))
    rows = points.select("x", "y").distinct().join(b, ["x", "y"], "left").join(i, ["x", "y"], "left").filter("_b = 1 or _i = 1")
    return rows.select("x", "y", F.when(F.col("_b").isNull(), "interior").when(F.col("_i").isNull(), "boundary").otherwise("both").alias("side"))


def retire_points(points: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points still referenced, points no longer referenced)."""
    return points.join(active, ["x", "y"], "left_semi"), points.join(active, ["x", "y"], "left_anti")


def drop_nonreciprocal(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    back = edges.select(F.col(dst).alias(src), F.col(src).alias(dst)).distinct()
    return edges.join(back, [src, dst], "left_semi")
