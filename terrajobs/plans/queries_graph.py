"""Queries of components, forests and basin links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrajobs.functions.scalars import planar_distance
from terrajobs.operators import components as G
from terrajobs.operators import forest as I
from terrajobs.operators import outlines as N
from terrajobs.operators import shapes as E
from terrajobs.plans.fixtures import Territory
from terrajobs.plans.queries_shape import CONN, RINGS, SEGS, conn, segs, ws_boxed
from terrajobs.plans.registry import query
from terrajobs.storage import stash

# Chains of 500 have their answer in closed form; the recursion over watersheds is shallow.
CHAIN_TOP = "id - id % 500"


@query(
    "i1_component_labels",
    """, near AS (SELECT DISTINCT blockid0, blockid1 FROM edges), reach AS (SELECT blockid AS id, blockid AS label FROM blocks UNION SELECT n.blockid1, r.label FROM reach r JOIN near n ON n.blockid0 = r.id)
  SELECT id AS blockid, min(label) AS component FROM reach GROUP BY id""",
)
def i1(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    return G.component_labels(t.blocks, t.edges, "blockid", "blockid0", "blockid1")


@query("i2_forest_roots", ", e AS (SELECT id FROM forest) SELECT f.id, (SELECT max(g.id) FROM forest g WHERE g.parentid IS NULL AND g.id <= f.id) AS root, f.id - (SELECT max(g.id) FROM forest g WHERE g.parentid IS NULL AND g.id <= f.id) AS depth FROM forest f")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return I.forest_roots(Territory(spark, sf).forest)


LOOPED = "id", "case when id % 1000 = 0 then id + 20 else parentid end as parentid"


@query("i3_find_cycles", " SELECT id FROM forest WHERE (id // 500) % 2 = 0 AND EXISTS (SELECT 1 FROM forest g WHERE g.id = (forest.id // 500) * 500 + 20)")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return I.find_cycles(Territory(spark, sf).forest.selectExpr(*LOOPED))


@query("i4_absorb_dead_ends", ", c AS (SELECT id, least(id - id % 10 + 9, max(id) OVER ()) AS last FROM points) SELECT id, last AS into FROM c WHERE id < last")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of ten points, the last one maybe shorter, each smaller than the next, drain into
    their last one, which lies on a ring of three more polygons."""
    p = Territory(spark, sf).points
    top = p.agg(F.max("id").alias("top"))
    p = p.join(F.broadcast(top), how="inner").selectExpr("id", "least(id - id % 10 + 9, top) as last")
    forward, ends = p.filter("id < last").selectExpr("id as src", "id + 1 as dst"), p.filter("id = last")
    ring = ends.selectExpr("id as src", "explode(array(-id - 1, -id - 1000001)) as dst")
    loop = ends.selectExpr("-id - 1 as src", "-id - 2000001 as dst").unionByName(ends.selectExpr("-id - 1000001 as src", "-id - 2000001 as dst"))
    e = forward.unionByName(ring).unionByName(loop)
    e = e.unionByName(e.selectExpr("dst as src", "src as dst"))
    areas = e.selectExpr("src as id").distinct().selectExpr("id", "case when id >= 0 then id else -1 end as area")
    return I.absorb_dead_ends(areas, e).filter("id >= 0")


@query("i5_boundary_flags", CONN + " SELECT wsid0 AS wsid, bool_or(wsid1 = 0) AS boundary FROM conn GROUP BY wsid0")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return E.boundary_flags(conn(Territory(spark, sf)))


FLOW = ", c AS (SELECT id // 3 AS id, CASE x % 4 WHEN 0 THEN 558 WHEN 1 THEN 460 WHEN 2 THEN 420 ELSE 334 END AS class, y % 3 - (id % 2) AS parent FROM points)"


@query("i6_preferred_flow_type", FLOW + """, o AS (SELECT id, class, min(parent) AS parent FROM c WHERE parent > 0 GROUP BY id, class HAVING count(DISTINCT parent) = 1)
  SELECT id, class, parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY class DESC) AS n FROM o) WHERE n = 1""")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    c = Territory(spark, sf).points.selectExpr("id div 3 as id", "case x % 4 when 0 then 558 when 1 then 460 when 2 then 420 else 334 end as class", "y % 3 - id % 2 as parent")
    return I.preferred_flow_type(c)


CLOSED = "wsid % 13 = 5 and wx % 5 <> 0"


def exits_in(t: Territory) -> tuple[DataFrame, ...]:
    """Watersheds, some of them closed basins, with rivers, interfaces, rings and lakes."""
    w = t.watersheds.withColumn("parentid", F.when(~F.expr(CLOSED), F.col("parentid")))
    ws = w.selectExpr("wsid as id", "parentid", "wx % 5 = 0 as boundary")
    cross = w.filter("wsid % 3 = 0 and parentid is not null").selectExpr("wsid as id", "parentid as parent", "explode(array(minx, minx + 2)) as x", "miny as y")
    faces = conn(t).join(w.selectExpr("wsid as wsid0", "minx", "miny"), "wsid0").filter("not (wsid0 % 7 = 1 and wsid1 = wsid0 - 1)")
    faces = faces.selectExpr("wsid0 as id", "case when wsid1 = 0 then cast(0 as long) else wsid1 end as neighbor", "minx + connectionid % 4 as x", "miny as y", "cast(connectionid % 4 + 1 as double) as length")
    lakes = w.filter(CLOSED).filter("wsid % 3 > 0").selectExpr("wsid as id", "explode(array(minx + 1, minx + 2)) as x", "miny + if(wsid % 3 = 1, 3, 6) as y")
    return ws, cross, faces, ws_boxed(t).select("id", "ring"), lakes


NEAREST = "row_number() OVER (PARTITION BY id ORDER BY dist, length DESC, x, y)"
I7 = CONN + f""", ws AS (SELECT wsid AS id, CASE WHEN NOT ({CLOSED}) THEN parentid END AS pid, wx % 5 = 0 AS boundary, minx, miny, maxy FROM watersheds),
  f AS (SELECT c.wsid0 AS id, c.wsid1 AS parent, w.minx + c.connectionid % 4 AS x, w.miny AS y, (c.connectionid % 4 + 1)::DOUBLE AS length FROM conn c JOIN watersheds w ON w.wsid = c.wsid0 WHERE NOT (c.wsid0 % 7 = 1 AND c.wsid1 = c.wsid0 - 1)),
  s0 AS (SELECT id, minx + CASE WHEN id % 3 = 0 THEN 2 ELSE 1.5 END AS x, CASE id % 3 WHEN 0 THEN miny + 2 WHEN 1 THEN miny + 3 ELSE maxy END AS y FROM ws WHERE pid IS NULL AND NOT boundary),
  s1 AS (SELECT id, parent, x, y FROM (SELECT *, {NEAREST} AS n FROM (SELECT f.*, round(abs(f.x - (w.minx + 1)), 6) AS dist FROM f JOIN ws w ON w.id = f.id AND w.pid = f.parent WHERE w.id % 3 = 0)) WHERE n = 1),
  rim AS (SELECT f.* FROM f JOIN ws USING (id) WHERE f.parent = 0 AND pid IS NULL AND boundary),
  s2 AS (SELECT id, x, y FROM (SELECT *, {NEAREST} AS n FROM (SELECT r.*, round(sqrt((r.x - m.mx) ** 2 + (r.y - m.my) ** 2), 6) AS dist FROM rim r JOIN (SELECT id, avg(x) AS mx, avg(y) AS my FROM rim GROUP BY id) m USING (id))) WHERE n = 1),
  rest AS (SELECT id, pid, boundary FROM ws WHERE pid IS NOT NULL AND id NOT IN (SELECT id FROM s1)),
  apart AS (SELECT * FROM rest r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = r.id AND f.parent = r.pid)),
  s4 AS (SELECT id, x, y FROM (SELECT *, {NEAREST} AS n FROM (SELECT f.*, round(sqrt((f.x - g.x) ** 2 + (f.y - g.y) ** 2), 6) AS dist FROM apart a JOIN f ON f.id = a.id JOIN f g ON g.id = a.pid WHERE NOT a.boundary)) WHERE n = 1),
  near AS (SELECT r.id, r.pid, f.x, f.y, f.length FROM rest r JOIN f ON f.id = r.id AND f.parent = r.pid),
  ends AS (SELECT id, x, y FROM f UNION SELECT id, x, y FROM s0),
  hop AS (SELECT id, pid, ex, ey, x, y FROM (SELECT n.*, e.x AS ex, e.y AS ey, row_number() OVER (PARTITION BY n.id, e.x, e.y ORDER BY round(sqrt((n.x - e.x) ** 2 + (n.y - e.y) ** 2), 6), length DESC, n.x, n.y) AS n FROM near n JOIN ends e ON e.id = n.pid) WHERE n = 1),
  front AS (SELECT id, x, y, 4 AS step FROM (SELECT id, x, y FROM s0 UNION ALL SELECT id, x, y FROM s1 UNION ALL SELECT id, x, y FROM s2 UNION ALL SELECT id, x, y FROM s4) UNION ALL SELECT h.id, h.x, h.y, p.step + 1 FROM front p JOIN hop h ON h.pid = p.id AND h.ex = p.x AND h.ey = p.y),
  found AS (SELECT id, parent, x, y, 1 AS step FROM s1 UNION ALL SELECT id, NULL, x, y, 0 FROM s0 UNION ALL SELECT id, NULL, x, y, 2 FROM s2 UNION ALL SELECT id, NULL, x, y, 4 FROM s4 UNION ALL SELECT f.id, r.pid, f.x, f.y, f.step FROM front f JOIN rest r USING (id) WHERE f.step > 4)"""


@query("i7_exit_points", I7 + " SELECT id, parent, round(x, 4) AS x, round(y, 4) AS y, step FROM found")
def i7(spark: SparkSession, sf: str) -> DataFrame:
    """River crossings lead into linked parents only, so no third step arises here; a test covers it."""
    return I.exit_points(*exits_in(Territory(spark, sf))).select("id", "parent", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "step")


PATHS = """, tree AS (SELECT wsid AS id, parentid, (wsid % 7)::DOUBLE AS d, wx % 5 < 3 AS boundary FROM watersheds),
  path AS (SELECT id, id AS at FROM tree UNION ALL SELECT p.id, t.parentid FROM path p JOIN tree t ON t.id = p.at WHERE t.parentid IS NOT NULL),
  sums AS (SELECT p.id, sum(t.d) AS sd, sum(CASE WHEN t.boundary THEN t.d ELSE 0 END) AS sb, max(t.d) AS most, max(CASE WHEN t.parentid IS NULL THEN t.id END) AS root FROM path p JOIN tree t ON t.id = p.at GROUP BY p.id)"""
DESC = CONN + PATHS + """, scored AS (SELECT c.wsid0, c.wsid1, a.root AS basin0, b.root AS basin1, c.connectionid % 3 + a.sd AS descent, CASE WHEN t.boundary AND u.boundary THEN c.connectionid % 3 ELSE 0 END + a.sb AS boundary_descent, c.connectionid AS cid
  FROM conn c JOIN sums a ON a.id = c.wsid0 JOIN sums b ON b.id = c.wsid1 JOIN tree t ON t.id = c.wsid0 JOIN tree u ON u.id = c.wsid1 WHERE c.wsid1 <> 0 AND a.root <> b.root)"""


def tree(t: Territory) -> DataFrame:
    return t.watersheds.selectExpr("wsid as id", "parentid", "cast(wsid % 7 as double) as exitdist", "wx % 5 < 3 as boundary")


def descents(t: Territory) -> DataFrame:
    return I.descent_distances(tree(t), conn(t).filter("wsid1 <> 0").selectExpr("wsid0", "wsid1", "cast(connectionid % 3 as double) as outside"))


@query("i8_descent_distances", DESC + " SELECT wsid0, wsid1, basin0, basin1, descent::DOUBLE AS descent, boundary_descent::DOUBLE AS boundary_descent FROM scored")
def i8(spark: SparkSession, sf: str) -> DataFrame:
    return descents(Territory(spark, sf))


@query("i9_best_basin_links", DESC + " SELECT basin0, basin1, wsid0, wsid1 FROM (SELECT *, row_number() OVER (PARTITION BY basin0, basin1 ORDER BY descent - boundary_descent, descent, wsid0, wsid1) AS n FROM scored) WHERE n = 1")
def i9(spark: SparkSession, sf: str) -> DataFrame:
    s = descents(Territory(spark, sf)).withColumn("island_area", F.lit(0.0)).withColumn("length", F.lit(4.0))
    return I.best_basin_links(s).select("basin0", "basin1", "wsid0", "wsid1")


I10 = CONN + PATHS + """, b AS (SELECT DISTINCT x.root AS b0, y.root AS b1 FROM conn c JOIN sums x ON x.id = c.wsid0 JOIN sums y ON y.id = c.wsid1 WHERE c.wsid1 <> 0),
  net AS (SELECT DISTINCT root AS b0, root AS label FROM sums UNION SELECT b.b1, n.label FROM net n JOIN b ON b.b0 = n.b0),
  whole AS (SELECT b0 AS root, min(label) AS label FROM net GROUP BY b0)
  SELECT s.id, s.root AS basinid, count(*) OVER (PARTITION BY w.label) AS joined, 1 AS roots, true AS linked FROM sums s JOIN whole w USING (root)"""


@query("i10_merge_basins", I10)
def i10(spark: SparkSession, sf: str) -> DataFrame:
    """How many watersheds each one's merged tree has and how many roots, and whether its own
    link is one of the source's or between neighbours."""
    t = Territory(spark, sf)
    near = conn(t).filter("wsid1 <> 0").select("wsid0", "wsid1")
    merged = stash(I.merge_basins(tree(t), near), "merged")
    sizes = merged.groupBy("rootbasinid").agg(F.count("*").alias("joined"), F.count_if(F.col("parentid").isNull()).cast("int").alias("roots"))
    known = tree(t).filter("parentid is not null").select("id", "parentid")
    pairs = known.union(known.select("parentid", "id")).union(near).distinct().toDF("id", "parentid").withColumn("_k", F.lit(True))
    return merged.join(sizes, "rootbasinid").join(pairs, ["id", "parentid"], "left").select("id", "basinid", "joined", "roots", (F.col("parentid").isNull() | F.col("_k").isNotNull()).alias("linked"))


@query("i11_reroot", ", tops AS (SELECT max(id) AS node, id // 500 AS c FROM forest GROUP BY id // 500) SELECT id, CASE WHEN id = node THEN NULL ELSE id + 1 END AS parentid FROM forest JOIN tops ON c = id // 500")
def i11(spark: SparkSession, sf: str) -> DataFrame:
    f = Territory(spark, sf).forest.select("id", "parentid")
    at = f.groupBy(F.expr("id div 500").alias("c")).agg(F.max("id").alias("node"))
    return I.reroot(f, at.select("node", F.lit(None).cast("long").alias("new_parent"))).join(at.select(F.col("node").alias("id"), F.lit(True).alias("top")), "id", "left").select("id", F.when(F.col("top").isNull(), F.col("parentid")).alias("parentid"))


# A link is made if and only if no chain of shorter ones joins its groups; ids settle ties.
I12 = """, g AS (SELECT id, owner AS groupid, owner % 2 AS stateid, x, y FROM points),
  d AS (SELECT stateid, g0, g1, min(k) AS k FROM (SELECT a.stateid, a.groupid AS g0, b.groupid AS g1, {'dist': sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE), 'lo': least(a.id, b.id), 'hi': greatest(a.id, b.id)} AS k FROM g a JOIN g b ON a.stateid = b.stateid AND a.groupid <> b.groupid) GROUP BY stateid, g0, g1),
  joined AS (SELECT g0, g1, k, g0 AS pos FROM d WHERE g0 < g1 UNION SELECT j.g0, j.g1, j.k, d.g1 FROM joined j JOIN d ON d.g0 = j.pos AND d.k < j.k)
  SELECT stateid, k.lo AS id0, k.hi AS id1, round(k.dist, 6) AS dist FROM d WHERE g0 < g1 AND NOT EXISTS (SELECT 1 FROM joined j WHERE j.g0 = d.g0 AND j.g1 = d.g1 AND j.pos = d.g1)"""


@query("i12_link_islands", I12)
def i12(spark: SparkSession, sf: str) -> DataFrame:
    """The links, and their lengths."""
    g = Territory(spark, sf).points.selectExpr("id", "owner as groupid", "owner % 2 as stateid", "x", "y")
    end = lambda k: g.select(F.col("id").alias(f"id{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("stateid").alias(f"s{k}"))
    links = I.link_islands(g).filter("id0 < id1").join(end(0), "id0").join(end(1), "id1")
    return links.select(F.col("s0").alias("stateid"), "id0", "id1", F.round(planar_distance("x0", "y0", "x1", "y1"), 6).alias("dist"))


@query("i13_subtree_sum", " SELECT id, sum(weight) OVER (PARTITION BY id // 500 ORDER BY id DESC)::BIGINT AS total FROM forest")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    return I.subtree_sum(Territory(spark, sf).forest, "weight")


@query("i28_river_lines", ", l AS (SELECT wsid FROM watersheds WHERE wsid NOT IN (SELECT parentid FROM watersheds WHERE parentid IS NOT NULL)) SELECT w.wsid AS id, 'flow' AS kind, w.minx AS x0, w.miny AS y0, p.minx AS x1, p.miny AS y1 FROM watersheds w JOIN watersheds p ON p.wsid = w.parentid UNION ALL SELECT wsid, 'leaf', maxx, maxy, minx, miny FROM watersheds JOIN l USING (wsid)")
def i28(spark: SparkSession, sf: str) -> DataFrame:
    return I.river_lines(Territory(spark, sf).watersheds.selectExpr("wsid as id", "parentid", "minx as x", "miny as y", "maxx as cx", "maxy as cy"))


@query("i28_link_lines", CONN + " SELECT DISTINCT a.wsid AS src, b.wsid AS dst, a.minx AS x0, a.miny AS y0, b.minx AS x1, b.miny AS y1 FROM conn c JOIN watersheds a ON a.wsid = least(wsid0, wsid1) JOIN watersheds b ON b.wsid = greatest(wsid0, wsid1) WHERE wsid1 <> 0")
def i28b(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    return I.link_lines(conn(t).filter("wsid1 <> 0").selectExpr("wsid0 as src", "wsid1 as dst"), t.watersheds.selectExpr("wsid as id", "minx as cx", "miny as cy"))


@query("i29_basin_crossings", " SELECT wsid AS id, wsid - 1 AS parentid FROM watersheds w WHERE EXISTS (SELECT 1 FROM watersheds v WHERE v.wsid = w.wsid - 1 AND v.wx // 3 <> w.wx // 3)")
def i29(spark: SparkSession, sf: str) -> DataFrame:
    w = Territory(spark, sf).watersheds
    return I.basin_crossings(w.selectExpr("wsid as id", "wsid - 1 as parentid"), w.selectExpr("wsid as id", "wx div 3 as basinid"))


@query("i29_flow_reversals", " SELECT parentid AS id, wsid AS parentid FROM watersheds WHERE parentid IS NOT NULL AND wsid % 2 = 0")
def i29b(spark: SparkSession, sf: str) -> DataFrame:
    w = Territory(spark, sf).watersheds.filter("parentid is not null").selectExpr("wsid as id", "parentid")
    turned = w.selectExpr("if(id % 2 = 0, parentid, id) as id", "if(id % 2 = 0, id, parentid) as parentid")
    return I.flow_reversals(turned, w)


# Left sides of odd columns are drawn 0.02 off; where a left neighbour's corner is near, both meet
# half way. Apart from them, pairs of segments cross and are tied at their nearest ends.
I26 = """, drawn AS (SELECT blockid * 4 + ordinal AS id, blockid AS owner, cx, x0, y0, x1, y1 FROM segments JOIN blocks USING (blockid)),
  corner AS (SELECT DISTINCT blocks.cx, y FROM blocks, (VALUES (0), (1)) AS v(k), LATERAL (SELECT cy + k AS y)),
  "at" AS (SELECT l.cx, l.y, EXISTS (SELECT 1 FROM corner r WHERE r.cx = l.cx - 1 AND r.y = l.y) AS met FROM corner l WHERE l.cx % 2 = 1),
  placed AS (SELECT id, owner, y0, y1, x0 + coalesce(CASE WHEN d.cx % 2 = 1 AND d.x0 = d.cx THEN CASE WHEN l0.met THEN 0.01 ELSE 0.02 END WHEN d.cx % 2 = 0 AND d.x0 = d.cx + 1 AND r0.met THEN 0.01 END, 0)::DOUBLE AS x0,
      x1 + coalesce(CASE WHEN d.cx % 2 = 1 AND d.x1 = d.cx THEN CASE WHEN l1.met THEN 0.01 ELSE 0.02 END WHEN d.cx % 2 = 0 AND d.x1 = d.cx + 1 AND r1.met THEN 0.01 END, 0)::DOUBLE AS x1
    FROM drawn d LEFT JOIN "at" l0 ON l0.cx = d.cx AND l0.y = d.y0 LEFT JOIN "at" l1 ON l1.cx = d.cx AND l1.y = d.y1 LEFT JOIN "at" r0 ON r0.cx = d.cx + 1 AND r0.y = d.y0 LEFT JOIN "at" r1 ON r1.cx = d.cx + 1 AND r1.y = d.y1),
  final AS (SELECT id, owner, round(x0, 4) AS x0, y0::DOUBLE AS y0, round(x1, 4) AS x1, y1::DOUBLE AS y1 FROM placed
    UNION ALL SELECT -1 - 2 * blockid, -1, 5.0 * blockid, 100000.5, 5.0 * blockid + 2, 100002 FROM blocks WHERE blockid % 25 = 0 UNION ALL SELECT -2 - 2 * blockid, -2, 5.0 * blockid, 100000.5, 5.0 * blockid + 2, 100000 FROM blocks WHERE blockid % 25 = 0)
  SELECT id, x0, y0, x1, y1, (SELECT count(*) FROM final b WHERE a.x0 = b.x1 AND a.y0 = b.y1 AND a.x1 = b.x0 AND a.y1 = b.y0) = 1 AS finished FROM final a"""


@query("i26_collapse_gaps", I26)
def i26(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    off = lambda k: f"cast(x{k} + if(cx % 2 = 1 and x{k} = cx, 0.02D, 0D) as double) as x{k}"
    s = t.segments.join(t.blocks.select("blockid", "cx"), "blockid").selectExpr("blockid * 4 + ordinal as id", "blockid as owner", off(0), "cast(y0 as double) as y0", off(1), "cast(y1 as double) as y1")
    b = t.blocks.filter("blockid % 25 = 0")
    lines = b.selectExpr("-1 - 2 * blockid as id", "-1L as owner", "5D * blockid as x0", "100000D as y0", "5D * blockid + 2 as x1", "100002D as y1").unionByName(b.selectExpr("-2 - 2 * blockid as id", "-2L as owner", "5D * blockid as x0", "100001D as y0", "5D * blockid + 2 as x1", "100000D as y1"))
    closed = E.collapse_gaps(s.unionByName(lines), 0.05)
    return closed.select("id", F.round("x0", 4).alias("x0"), "y0", F.round("x1", 4).alias("x1"), "y1", "finished")


@query("i27_stitch_rings", SEGS + RINGS + " SELECT stateid, ring, ordinal, x0, y0, x1, y1 FROM ringed")
def i27(spark: SparkSession, sf: str) -> DataFrame:
    """Every outline of both states, dart by dart."""
    return N.rings(N.outline_segments(segs(Territory(spark, sf)), ["stateid"]), ["stateid"])
