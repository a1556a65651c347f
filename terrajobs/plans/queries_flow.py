"""Queries of populations along the flow forest and of districting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrajobs.operators import districts as I
from terrajobs.operators import forest as T
from terrajobs.operators import summaries as D
from terrajobs.plans.fixtures import Territory
from terrajobs.plans.queries_shape import MAPPED, mapped
from terrajobs.plans.registry import query
from terrajobs.storage import stash

SIZE = 1500

UPSTREAM = (
    MAPPED
    + """, own AS (SELECT w.wsid AS id, w.parentid, coalesce(sum(b.population), 0)::BIGINT AS population FROM watersheds w LEFT JOIN mapped m USING (wsid) LEFT JOIN blocks b USING (blockid) GROUP BY w.wsid, w.parentid),
  known AS (SELECT o.id, p.id AS parentid, o.population FROM own o LEFT JOIN own p ON p.id = o.parentid),
  path AS (SELECT id, id AS at FROM known UNION ALL SELECT p.id, k.parentid FROM path p JOIN known k ON k.id = p.at WHERE k.parentid IS NOT NULL),
  branch AS (SELECT p.at AS id, sum(k.population)::BIGINT AS branchpopulation FROM path p JOIN known k ON k.id = p.id GROUP BY p.at),
  btree AS (SELECT k.id, k.parentid, k.population, b.branchpopulation FROM known k JOIN branch b USING (id))"""
)


def upstream(t: Territory) -> DataFrame:
    """(id, parentid, population, branchpopulation) of every watershed."""
    own = stash(D.watershed_population(mapped(t), t.blocks, t.watersheds), "population")  # read by every round
    tree = own.join(t.watersheds.select("wsid", "parentid"), "wsid").select(F.col("wsid").alias("id"), "parentid", "population")
    return tree.join(T.subtree_sum(tree, "population", "branchpopulation"), "id")


@query("upstream_population", UPSTREAM + f" SELECT id, population, branchpopulation, branchpopulation >= {SIZE} AS holds_district FROM btree")
def upstream_population(spark: SparkSession, sf: str) -> DataFrame:
    return upstream(Territory(spark, sf)).select("id", "population", "branchpopulation", (F.col("branchpopulation") >= SIZE).alias("holds_district"))


@query(
    "i14_branch_roots",
    UPSTREAM
    + f""", steps AS (SELECT id, parentid IS NULL AND branchpopulation < 1.5 * {SIZE} AS last FROM btree WHERE parentid IS NULL
    UNION ALL SELECT c.id, false FROM steps s JOIN btree c ON c.parentid = s.id WHERE c.branchpopulation > {SIZE} AND NOT s.last)
  SELECT s.id, s.last FROM steps s JOIN btree b USING (id) WHERE s.last OR (b.branchpopulation >= {SIZE} AND NOT EXISTS (SELECT 1 FROM btree c WHERE c.parentid = s.id AND c.branchpopulation > {SIZE}))""",
)
def i14(spark: SparkSession, sf: str) -> DataFrame:
    return T.branch_roots(upstream(Territory(spark, sf)).withColumn("closed", F.lit(False)), SIZE)


CHAINS = ", b AS (SELECT id, parentid, sum(weight) OVER (PARTITION BY id // 500 ORDER BY id DESC)::BIGINT AS total FROM forest)"


@query(
    "i15_next_downstream",
    CHAINS + " SELECT s.id, coalesce((SELECT max(d.id) FROM b d WHERE d.id // 500 = s.id // 500 AND d.id < s.id AND d.total >= s.total + 60), s.id - s.id % 500 + (SELECT min(m.id % 500) FROM b m WHERE m.id // 500 = s.id // 500)) AS found FROM b s",
)
def i15(spark: SparkSession, sf: str) -> DataFrame:
    f = Territory(spark, sf).forest
    tree = f.join(T.subtree_sum(f, "weight", "branchpopulation"), "id").withColumn("boundary", F.lit(True))
    return T.next_downstream(tree, tree.select("id", F.col("branchpopulation").alias("need")), 60)


OPEN = """, b AS (SELECT blockid, stateid * 10 + cx // 10 AS rootid, CASE WHEN cy % 8 = 7 THEN 5 + cx % 2 END AS districtid, population, cx::DOUBLE AS x, cy::DOUBLE AS y FROM blocks),
  near AS (SELECT DISTINCT blockid0 AS src, blockid1 AS dst FROM edges), inside AS (SELECT n.src, n.dst FROM near n JOIN b p ON p.blockid = n.src JOIN b q ON q.blockid = n.dst WHERE p.rootid = q.rootid AND p.districtid IS NULL AND q.districtid IS NULL),
  reach AS (SELECT blockid AS id, blockid AS label FROM b WHERE districtid IS NULL UNION SELECT i.dst, r.label FROM reach r JOIN inside i ON i.src = r.id),
  groups AS (SELECT id AS blockid, min(label) AS groupid FROM reach GROUP BY id),
  beside AS (SELECT g.groupid, string_agg(DISTINCT coalesce(q.districtid, 0)::VARCHAR, ',' ORDER BY coalesce(q.districtid, 0)::VARCHAR) AS neighbors, bool_or(q.districtid IS NULL) AS open FROM groups g JOIN near n ON n.src = g.blockid JOIN b q ON q.blockid = n.dst LEFT JOIN groups h ON h.blockid = n.dst WHERE h.groupid IS DISTINCT FROM g.groupid GROUP BY g.groupid),
  summed AS (SELECT g.groupid, min(b.rootid) AS rootid, sum(b.population)::BIGINT AS population, round(avg(b.x), 4) AS x FROM groups g JOIN b USING (blockid) GROUP BY g.groupid)"""


def open_blocks(t: Territory) -> tuple[DataFrame, DataFrame]:
    b = t.blocks.selectExpr("blockid", "stateid * 10 + cx div 10 as rootid", "case when cy % 8 = 7 then 5 + cx % 2 end as districtid", "population", "cast(cx as double) as x", "cast(cy as double) as y", "1D as area")
    return b, t.edges.selectExpr("blockid0 as src", "blockid1 as dst")


@query("i16_open_groups", OPEN + " SELECT s.groupid, s.rootid, s.population, s.x, coalesce(n.neighbors, '') AS neighbors FROM summed s LEFT JOIN beside n USING (groupid)")
def i16(spark: SparkSession, sf: str) -> DataFrame:
    _, groups = I.open_groups(*open_blocks(Territory(spark, sf)))
    return groups.select("groupid", "rootid", "population", F.round("x", 4).alias("x"), F.array_join(F.transform("neighbors", lambda v: v.cast("string")), ",").alias("neighbors"))


@query(
    "i17_stranded_groups",
    OPEN
    + """, s AS (SELECT s.*, coalesce(n.open, false) AS open FROM summed s LEFT JOIN beside n USING (groupid)), m AS (SELECT *, bool_or(open) OVER (PARTITION BY rootid) AS anyopen, row_number() OVER (PARTITION BY rootid ORDER BY population DESC, groupid) AS k FROM s)
  SELECT groupid, rootid FROM m WHERE NOT open AND (anyopen OR k > 1)""",
)
def i17(spark: SparkSession, sf: str) -> DataFrame:
    _, groups = I.open_groups(*open_blocks(Territory(spark, sf)))
    return I.stranded_groups(groups).select("groupid", "rootid")


# Each open block's district: layer by layer from the assigned ones, the preferred one first.
I18 = OPEN + """, t AS (SELECT wsid, parentid, 4 * wx AS tx, 4 * wy AS ty FROM watersheds), v AS (SELECT b.*, (y::BIGINT // 4) * 10 + x::BIGINT // 4 AS wsid FROM b),
  hop AS (SELECT wsid, parentid AS below FROM t WHERE parentid IS NOT NULL UNION ALL SELECT h.wsid, t.parentid FROM hop h JOIN t ON t.wsid = h.below WHERE t.parentid IS NOT NULL AND h.below NOT IN (SELECT wsid FROM v)),
  under AS (SELECT wsid, below FROM hop WHERE below IN (SELECT wsid FROM v)),
  gw AS (SELECT DISTINCT groupid, wsid FROM groups JOIN v USING (blockid)),
  way AS (SELECT groupid, wsid, wsid AS pos, 0 AS k FROM gw UNION ALL SELECT p.groupid, p.wsid, u.below, k + 1 FROM way p JOIN under u ON u.wsid = p.pos JOIN gw ON gw.groupid = p.groupid AND gw.wsid = u.below),
  leave AS (SELECT groupid, w.wsid, tx, ty FROM (SELECT groupid, wsid, arg_max(pos, k) AS pos FROM way GROUP BY ALL) w JOIN t ON t.wsid = w.pos),
  rim AS (SELECT DISTINCT g.groupid, q.blockid AS nb, q.wsid, q.districtid, q.x, q.y FROM groups g JOIN near n ON n.src = g.blockid JOIN v q ON q.blockid = n.dst WHERE q.districtid IS NOT NULL),
  named AS (SELECT l.groupid, l.wsid, r.districtid, r.nb, sqrt((r.x - tx) * (r.x - tx) + (r.y - ty) * (r.y - ty)) AS d, EXISTS (SELECT 1 FROM way p WHERE p.groupid = l.groupid AND p.wsid = l.wsid AND p.pos = r.wsid) AS onway FROM leave l JOIN rim r USING (groupid)),
  wish AS (SELECT groupid, wsid, districtid AS prefers FROM (SELECT *, row_number() OVER (PARTITION BY groupid, wsid ORDER BY onway DESC, d, nb) AS n FROM named) WHERE n = 1),
  free AS (SELECT v.blockid, v.x, v.y, w.prefers FROM v JOIN groups USING (blockid) LEFT JOIN wish w ON w.groupid = groups.groupid AND w.wsid = v.wsid),
  far AS (SELECT blockid, 0 AS layer FROM b WHERE districtid IS NOT NULL UNION SELECT n.dst, layer + 1 FROM far JOIN near n ON n.src = far.blockid JOIN b ON b.blockid = n.dst WHERE b.districtid IS NULL AND layer < 60),
  lay AS (SELECT blockid, min(layer) AS layer FROM far GROUP BY blockid),
  grown AS (SELECT blockid, districtid, 0 AS layer FROM b WHERE districtid IS NOT NULL
    UNION ALL SELECT blockid, districtid, layer FROM (SELECT f.blockid, g.districtid, l.layer, row_number() OVER (PARTITION BY f.blockid ORDER BY coalesce(g.districtid = f.prefers, false) DESC, (f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y), g.districtid, s.blockid) AS n
      FROM grown g JOIN near ON near.src = g.blockid JOIN free f ON f.blockid = near.dst JOIN lay l ON l.blockid = f.blockid AND l.layer = g.layer + 1 JOIN b s ON s.blockid = g.blockid) WHERE n = 1)"""


@query("i18_snap_stranded", I18 + " SELECT blockid, districtid FROM grown WHERE layer > 0")
def i18(spark: SparkSession, sf: str) -> DataFrame:
    """All open land is taken as stranded: which district each of its blocks joins."""
    t = Territory(spark, sf)
    b, e = open_blocks(t)
    b = b.withColumn("wsid", F.expr("(cast(y as long) div 4) * 10 + cast(x as long) div 4"))
    labels, _ = I.open_groups(b, e)
    tree = t.watersheds.selectExpr("wsid as id", "parentid", "4 * wx as x", "4 * wy as y")
    return I.snap_stranded(b.join(labels, "blockid"), e, b.filter("districtid is not null"), tree, b)


@query("i19_close_branches", ", n AS (SELECT id, sum(CASE WHEN id % 500 > 400 THEN 0 ELSE weight END) OVER (PARTITION BY id // 500 ORDER BY id DESC) AS n FROM forest) SELECT id, n = 0 AS closed FROM n")
def i19(spark: SparkSession, sf: str) -> DataFrame:
    return T.close_branches(Territory(spark, sf).forest.withColumn("openblocks", F.when(F.col("id") % 500 > 400, 0).otherwise(F.col("weight"))))


@query(
    "i20_farthest_boundary_node",
    ", c AS (SELECT id - id % 500 + (CASE WHEN id % 500 >= 250 THEN 250 ELSE 0 END) AS start, id, (id * 7919 % 1009)::DOUBLE AS dist FROM forest WHERE id % 500 < 200 OR id % 500 >= 250), k AS (SELECT * FROM c WHERE start % 500 = 250) SELECT start, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY dist DESC, id) AS n FROM k) WHERE n = 1",
)
def i20(spark: SparkSession, sf: str) -> DataFrame:
    f = Territory(spark, sf).forest.withColumn("boundary", F.expr("id % 500 < 200 or id % 500 >= 250"))
    return I.farthest_boundary_node(f, f.filter("id % 500 = 250").select(F.col("id").alias("start")), f.select("id", F.expr("cast(id * 7919 % 1009 as double) as dist")))


def swept(t: Territory) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks with their watershed, edges, and the districts of a whole sweep."""
    near = t.blocks.selectExpr("blockid", "(cy div 4) * 10 + cx div 4 as wsid", "stateid", "population", "cast(cx as double) as x", "cast(cy as double) as y")
    tree = t.watersheds.selectExpr("wsid as id", "parentid", "minx as x", "miny as y", "wx % 5 = 0 as boundary")
    blocks = near.join(tree.select(F.col("id").alias("wsid")), "wsid", "left_semi")
    edges = t.edges.selectExpr("blockid0 as src", "blockid1 as dst")
    return blocks, edges, I.district_sweep(blocks, edges, tree, 3 * SIZE)


@query("i21_district_sweep")
def i21(spark: SparkSession, sf: str) -> DataFrame:
    """Districts of all blocks."""
    return swept(Territory(spark, sf))[2]


@query("i21_sweep_report", " SELECT stateid, sum(population)::BIGINT AS population, count(*) AS blocks, 0 AS unassigned, 0 AS broken, 0 AS mixed FROM blocks GROUP BY stateid")
def i21b(spark: SparkSession, sf: str) -> DataFrame:
    """Per state: what the districts hold, blocks without one, blocks outside their district's
    largest connected part, and districts over several states."""
    blocks, edges, districts = swept(Territory(spark, sf))
    own = stash(blocks.join(districts, "blockid"), "own")
    whole = I.keep_largest_part(own, edges).withColumnRenamed("districtid", "kept")
    mixed = own.groupBy("districtid").agg(F.count_distinct("stateid").alias("states")).filter("states > 1").select("districtid", F.lit(True).alias("_m"))
    rows = own.join(whole, "blockid").join(mixed, "districtid", "left")
    return rows.groupBy("stateid").agg(F.sum("population").cast("long").alias("population"), F.count("*").alias("blocks"), F.count_if(F.col("districtid").isNull()).alias("unassigned"), F.count_if(F.col("kept").isNull()).alias("broken"), F.count_if(F.col("_m").isNotNull()).alias("mixed"))


@query("i22_apply_assignment", " SELECT blockid, CASE WHEN blockid % 2 = 0 THEN 100 ELSE blockid % 3 END AS districtid FROM blocks")
def i22(spark: SparkSession, sf: str) -> DataFrame:
    b = Territory(spark, sf).blocks.selectExpr("blockid", "blockid % 3 as districtid")
    return I.apply_assignment(b, b.filter("blockid % 2 = 0").selectExpr("blockid", "100L as districtid"))


@query("i22_branch_deltas", ", b AS (SELECT id, sum(CASE WHEN id % 3 = 0 THEN weight - 20 ELSE weight END) OVER (PARTITION BY id // 500 ORDER BY id DESC)::BIGINT AS total FROM forest) SELECT id, total FROM b")
def i22b(spark: SparkSession, sf: str) -> DataFrame:
    """Branch sums kept up to date: 20 less at every third node, taken off all nodes below."""
    f = stash(Territory(spark, sf).forest, "forest")
    before = T.subtree_sum(f, "weight")
    down = T.Downstream(f).push(f.filter("id % 3 = 0").select("id", F.lit(-20).cast("long").alias("change")), ["change"])
    return before.join(down, "id", "left").select("id", (F.col("total") + F.coalesce("change", F.lit(0))).alias("total"))


PARTED = """, b AS (SELECT blockid, cx % 4 // 2 AS districtid, population FROM blocks), near AS (SELECT DISTINCT n.blockid0 AS src, n.blockid1 AS dst FROM edges n JOIN b p ON p.blockid = n.blockid0 JOIN b q ON q.blockid = n.blockid1 WHERE p.districtid = q.districtid),
  reach AS (SELECT blockid AS id, blockid AS label FROM b UNION SELECT n.dst, r.label FROM reach r JOIN near n ON n.src = r.id), part AS (SELECT id AS blockid, min(label) AS component FROM reach GROUP BY id),
  best AS (SELECT districtid, component, row_number() OVER (PARTITION BY districtid ORDER BY sum(population) DESC, component) AS k FROM part JOIN b USING (blockid) GROUP BY districtid, component)
  SELECT b.blockid, CASE WHEN best.k = 1 THEN b.districtid END AS districtid FROM b JOIN part USING (blockid) JOIN best USING (districtid, component)"""


@query("i23_keep_largest_part", PARTED)
def i23(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    return I.keep_largest_part(t.blocks.selectExpr("blockid", "cx % 4 div 2 as districtid", "population"), t.edges.selectExpr("blockid0 as src", "blockid1 as dst"))


@query(
    "i24_artificial_edge",
    """, b AS (SELECT blockid, cy // 5 AS districtid, cx::DOUBLE AS x, cy::DOUBLE AS y FROM blocks WHERE cy % 5 < 3), e AS (SELECT DISTINCT b.*, round(sqrt(pow(x - 20, 2) + pow(y - 7, 2)), 9) AS d FROM b JOIN edges n ON n.blockid0 = b.blockid JOIN blocks p ON p.blockid = n.blockid1 WHERE p.cy % 5 >= 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY districtid ORDER BY d DESC, blockid) AS far, row_number() OVER (PARTITION BY districtid ORDER BY d, blockid) AS near FROM e)
  SELECT r.districtid, round(max(sqrt(pow(r.x - f.x, 2) + pow(r.y - f.y, 2))), 5) AS edgelength, min(CASE WHEN r.near = 1 THEN r.blockid END) AS nearest FROM r JOIN r f ON f.districtid = r.districtid AND f.far = 1 GROUP BY r.districtid""",
)
def i24(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    b = t.blocks.selectExpr("blockid", "case when cy % 5 < 3 then cy div 5 end as districtid", "cast(cx as double) as x", "cast(cy as double) as y", "20D as rx", "7D as ry")
    return I.artificial_edge(b, t.edges.selectExpr("blockid0 as src", "blockid1 as dst"), t.blocks.filter("cy % 5 >= 3").select("blockid")).withColumn("edgelength", F.round("edgelength", 5))


@query("i25_pick_shorter_edge", ", c AS (SELECT owner AS rootid, id % 2 = 1 AS boundary, min(x % 13) AS edgelength FROM points GROUP BY 1, 2) SELECT rootid, boundary, edgelength FROM (SELECT *, row_number() OVER (PARTITION BY rootid ORDER BY edgelength, boundary DESC) AS n FROM c) WHERE n = 1")
def i25(spark: SparkSession, sf: str) -> DataFrame:
    c = Territory(spark, sf).points.groupBy(F.col("owner").alias("rootid"), (F.col("id") % 2 == 1).alias("boundary")).agg(F.min(F.col("x") % 13).alias("edgelength"))
    return I.pick_shorter_edge(c)


@query(
    "i30_trim_overfull",
    """, b AS (SELECT blockid, stateid * 100 + cy // 3 AS districtid, population, cx * 3 % 17 AS score FROM blocks), r AS (SELECT *, sum(population) OVER (PARTITION BY districtid) - sum(population) OVER (PARTITION BY districtid ORDER BY score DESC, blockid) AS rest FROM b),
  s AS (SELECT *, max(CASE WHEN rest <= 700 THEN 1 ELSE 0 END) OVER (PARTITION BY districtid ORDER BY score DESC, blockid) AS stopped FROM r) SELECT blockid, districtid FROM s WHERE stopped = 0""",
)
def i30(spark: SparkSession, sf: str) -> DataFrame:
    return I.trim_overfull(Territory(spark, sf).blocks.selectExpr("blockid", "stateid * 100 + cy div 3 as districtid", "population", "cx * 3 % 17 as score"), 700)
