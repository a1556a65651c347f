"""Queries of sources, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrajobs.functions import rings as R
from terrajobs.functions import scalars as S
from terrajobs.operators import filters as B
from terrajobs.plans.fixtures import Territory
from terrajobs.plans.registry import query
from terrajobs.sources import tables as A
from terrajobs.storage import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


STATE_SQL = ", states AS (SELECT stateid, 'State ' || stateid AS name, sum(population)::BIGINT AS population, count(*) AS blocks, max(cx)::BIGINT % 7 AS representatives FROM blocks GROUP BY stateid)"


def states(t: Territory) -> DataFrame:
    return t.blocks.groupBy("stateid").agg(F.sum("population").alias("population"), F.count("*").alias("blocks"), (F.max("cx") % 7).cast("int").alias("representatives")).withColumn("name", F.concat(F.lit("State "), F.col("stateid").cast("string")))


@query("a1_read_block_tally", STATE_SQL + " SELECT stateid, name, blocks::VARCHAR AS blocks2010 FROM states")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    rows = states(Territory(spark, sf)).selectExpr("concat_ws('\t', concat('0', stateid, ' '), concat(name, ' '), cast(blocks as string), '', '', '') as line")
    more = spark.range(1).selectExpr("explode(array('FIPS State Code\tName\ta\tb\tc\td', ' \tUnited States\t1\t2\t3\t4', '\t\t\t\t\t')) as line")
    rows.union(more).write.text(path := _folder(spark, "tally"))
    return A.read_block_tally(spark, path).select("stateid", "name", "blocks2010")


@query("a2_read_apportionment", STATE_SQL + " SELECT name AS state, population::VARCHAR AS population, representatives FROM states WHERE representatives > 4")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    rows = states(Territory(spark, sf)).selectExpr("name as state", "cast(population as string) as population", "case when representatives > 4 then representatives end as representatives")
    rows.write.csv(path := _folder(spark, "seats"), header=True)
    return A.read_apportionment(spark, path)


@query("a3_read_block_parts", " SELECT row_number() OVER (ORDER BY lpad(blockid::VARCHAR, 10, '0')) AS id, lpad(blockid::VARCHAR, 10, '0') AS blockid10, stateid, population FROM blocks")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    b = Territory(spark, sf).blocks.selectExpr("lpad(cast(blockid as string), 10, '0') as blockid10", "cast(stateid as string) as statefp10", "population as pop10")
    paths = []
    for s in ("1", "2"):
        b.filter(F.col("statefp10") == s).write.parquet(path := _folder(spark, "part"))
        paths.append(path)
    return A.read_block_parts(spark, paths).select("id", "blockid10", "stateid", "population")


@query("a4_write_table", " SELECT blockid, population, stateid FROM blocks")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    A.write_table(Territory(spark, sf).blocks.select("blockid", "population", "stateid"), path := _folder(spark, "table"), ["stateid"])
    return spark.read.parquet(path)


@query("a5_export_district_blocks", " SELECT stateid, (blockid % 5)::VARCHAR AS districtid, lpad(blockid::VARCHAR, 10, '0') AS blockid10 FROM blocks")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    b = Territory(spark, sf).blocks
    A.export_district_blocks(b.selectExpr("blockid", "blockid % 5 as districtid"), b.selectExpr("blockid", "stateid", "lpad(cast(blockid as string), 10, '0') as blockid10"), path := _folder(spark, "export"))
    return spark.read.schema("districtid string, blockid10 string, stateid long").csv(path, header=True)


@query(
    "a6_placemark_rows",
    """, d AS (SELECT stateid, blockid AS districtid, population * 1000 AS population, cx, cy FROM blocks)
  SELECT stateid, districtid, 0 AS part, '<Folder>' AS line FROM d UNION ALL SELECT stateid, districtid, 4, '</Folder>' FROM d
  UNION ALL SELECT stateid, districtid, 1, '<name>District ' || districtid || ': ' || format('{:,}', population) || '</name>' FROM d
  UNION ALL SELECT stateid, districtid, 2, '<Point>' || cx || '.0,' || cy || '.0</Point>' FROM d
  UNION ALL SELECT stateid, districtid, 3, '<Polygon>' || cx || '.0,' || cy || '.0 ' || cx || '.0,' || cy + 1 || '.0 ' || cx + 1 || '.0,' || cy + 1 || '.0 ' || cx + 1 || '.0,' || cy || '.0 ' || cx || '.0,' || cy || '.0</Polygon>' FROM d""",
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    d = Territory(spark, sf).block_rings.selectExpr("stateid", "blockid as districtid", "population * 1000 as population", "ring[0].x as x", "ring[0].y as y", "ring")
    return A.placemark_rows(d)


@query("a7_save_assignment", " SELECT blockid AS id, blockid % 5 AS districtid FROM blocks WHERE blockid % 3 <> 0")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    A.save_assignment(Territory(spark, sf).blocks.selectExpr("blockid", "case when blockid % 3 <> 0 then blockid % 5 end as districtid"), path := _folder(spark, "assigned"))
    return spark.read.parquet(path)


CODED = "wsid as id", "lpad(cast(wsid as string), 12, '0') as code", "case when parentid is null then 'OCEAN' else lpad(cast(parentid as string), 12, '0') end as tocode"
CODED_SQL = ", coded AS (SELECT wsid AS id, lpad(wsid::VARCHAR, 12, '0') AS code, CASE WHEN parentid IS NULL THEN 'OCEAN' ELSE lpad(parentid::VARCHAR, 12, '0') END AS tocode FROM watersheds)"


@query("b1_apply_link_fixes", CODED_SQL + " SELECT id, code, CASE WHEN id % 7 = 3 THEN 'OCEAN' ELSE tocode END AS tocode FROM coded")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    w = Territory(spark, sf).watersheds.selectExpr(*CODED)
    return B.apply_link_fixes(w, w.filter("id % 7 = 3").selectExpr("code", "'OCEAN' as tocode"))


@query(
    "b2_uniquify_codes",
    """, c AS (SELECT p_partkey AS id, 'HUC' || lpad((p_partkey // 3 * (p_partkey % 2))::VARCHAR, 9, '0') AS code FROM part),
  d AS (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM c),
  e AS (SELECT id, substr(code, 1, 10) || (99 - row_number() OVER (ORDER BY code, id)) AS code FROM d WHERE n > 1)
  SELECT id, code FROM e UNION ALL SELECT id, code FROM d WHERE n = 1""",
)
def b2(spark: SparkSession, sf: str) -> DataFrame:
    c = Territory(spark, sf).raw("part").selectExpr("p_partkey as id", "concat('HUC', lpad(cast(p_partkey div 3 * (p_partkey % 2) as string), 9, '0')) as code")
    return B.uniquify_codes(c)


@query("b3_resolve_parents", CODED_SQL + " SELECT a.id, a.code, a.tocode, b.id AS parentid FROM coded a LEFT JOIN coded b ON a.tocode = b.code AND a.id <> b.id")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return B.resolve_parents(Territory(spark, sf).watersheds.selectExpr(*CODED)).select("id", "code", "tocode", "parentid")


@query("b4_wrap_antimeridian", " SELECT blockid, CASE WHEN cx - 20 + 0.5 > 0 THEN round(cx - 20 - 40075016.6855785, 3) ELSE cx - 20 END::DOUBLE AS x0, cy::DOUBLE AS y0 FROM blocks")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    rows = Territory(spark, sf).block_rings.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] - 20).alias("x"), p["y"].alias("y"))))
    return B.wrap_antimeridian(rows).selectExpr("blockid", "round(ring[0].x, 3) as x0", "ring[0].y as y0")


@query("b5_polygon_parts", " SELECT blockid, 0 AS part, 5 AS n_points, 1.0::DOUBLE AS area, cx::DOUBLE AS x1, (cy + 1)::DOUBLE AS y1 FROM blocks")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    rows = Territory(spark, sf).block_rings
    doubled = F.concat(F.slice("ring", 1, 1), F.reverse("ring"))  # counter-clockwise, first point twice
    few = F.slice("ring", 1, 3)
    return B.polygon_parts(rows.select("blockid", F.array(F.array(doubled, F.col("ring")), F.array(few)).alias("polygons"))).select(
        "blockid", "part", F.size("ring").alias("n_points"), R.ring_area(F.col("ring")).alias("area"), F.expr("ring[1].x as x1"), F.expr("ring[1].y as y1")
    )


FEATURES = "blockid", "case stateid when 1 then 'Lake' else 'River' end as type", "concat('n', blockid % 11) as name1", "case when blockid % 2 = 0 then concat('m', blockid % 5) end as name2", "cast(null as string) as name3", "cast(cx as double) as minx", "cast(cy as double) as miny", "cx + 1D as maxx", "cy + 1D as maxy"


@query("b6_filter_features", " SELECT blockid FROM blocks WHERE (stateid = 1 OR blockid % 11 = 4 OR (blockid % 2 = 0 AND blockid % 5 = 3)) AND cx <= 30 AND cx + 1 >= 5 AND cy <= 100 AND cy + 1 >= 2")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    return B.filter_features(Territory(spark, sf).blocks.selectExpr(*FEATURES), ["lake%"], ["n4", "m3"], (5, 2, 30, 100)).select("blockid")


@query("b7_filter_bbox", " SELECT blockid FROM blocks WHERE cx <= 12 AND cx + 1 >= 3 AND cy <= 40 AND cy + 1 >= 1")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    return B.filter_bbox(Territory(spark, sf).blocks.selectExpr(*FEATURES), (3, 1, 12, 40)).select("blockid")


@query("b8_filter_flow_class", " SELECT blockid, (blockid % 300 + 33300) // 100 AS class FROM blocks WHERE substr((blockid % 300 + 33300)::VARCHAR, 1, 3) IN ('334', '335')")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    return B.filter_flow_class(Territory(spark, sf).blocks.selectExpr("blockid", "blockid % 300 + 33300 as fcode"), ["334", "335"]).select("blockid", "class")


@query("b9_tag_border_members", " SELECT blockid, blockid % 4 IN (1, 3) AS border FROM blocks")
def b9(spark: SparkSession, sf: str) -> DataFrame:
    return B.tag_border_members(Territory(spark, sf).blocks.selectExpr("blockid", "element_at(array('MN,WI', 'MN,CN', 'TX', 'mx,TX'), cast(blockid % 4 as int) + 1) as states"), ["CN", "MX"]).select("blockid", "border")


@query("b10_drop_degenerate", " SELECT id, x AS x0, y AS y0, x + id % 3 AS x1, y AS y1 FROM points WHERE id % 3 <> 0")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return B.drop_degenerate(Territory(spark, sf).points.selectExpr("id", "x as x0", "y as y0", "x + id % 3 as x1", "y as y1"))


@query("b11_select_states", STATE_SQL + " SELECT stateid, name, population, representatives, round_even(population / representatives, 0)::BIGINT AS districtsize FROM states WHERE representatives > 0")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    return B.select_states(states(Territory(spark, sf))).select("stateid", "name", "population", "representatives", "districtsize")


@query("b12_pooled_territory", " SELECT blockid, 1 AS stateid, stateid AS originalstateid, (SELECT sum(population)::BIGINT FROM blocks) AS total FROM blocks")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    s = states(t)
    pooled, _, reps = B.pooled_territory(t.blocks, s.select("name", "stateid"), s.selectExpr("name as state", "population", "representatives"))
    total = reps.filter("state = 'USA'").select(F.col("population").alias("total"))
    return pooled.join(F.broadcast(total), how="inner").select("blockid", "stateid", "originalstateid", "total")


@query("b13_add_missing_seats", STATE_SQL + " SELECT name AS state, population, representatives FROM states UNION ALL SELECT name, population, 1 FROM states WHERE name = 'State 2'")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    t = Territory(spark, sf)
    s = states(t)
    return B.add_missing_seats(s.selectExpr("name as state", "population", "representatives"), s.select("name", "stateid"), t.blocks, ["State 2"])


TILE_SQL = "(least(greatest((x - 5000) * 5000.0::DOUBLE, -20037508.34278925), 20037508.34278925))"


@query(
    "h1_mercator_tile",
    """ SELECT id, least(greatest(floor((least(greatest((x - 5000) * 5000.0::DOUBLE, -20037508.34278925), 20037508.34278925) + 20037508.34278925) * 8192 / 40075016.6855785), 0), 8191)::INT AS tx,
  least(greatest(floor((20037508.34278925 - least(greatest((y - 5000) * 5000.0::DOUBLE, -20037508.34278925), 20037508.34278925)) * 8192 / 40075016.6855785), 0), 8191)::INT AS ty FROM points""",
)
def h1(spark: SparkSession, sf: str) -> DataFrame:
    tile = S.mercator_tile(13, (F.col("x") - 5000) * 5000.0, (F.col("y") - 5000) * 5000.0)
    return Territory(spark, sf).points.select("id", tile.alias("t")).select("id", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"))


MORTON_SQL = "list_sum(list_transform(range(16), lambda i: (((x >> i) & 1) << (2 * i + 1)) + (((y >> i) & 1) << (2 * i))))::BIGINT"


@query("h2_morton_code", f" SELECT id, {MORTON_SQL} AS code FROM points")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    return Territory(spark, sf).points.select("id", S.morton_code("x", "y").alias("code"))


@query("h3_morton_parent", f" SELECT id, ({MORTON_SQL}) >> 6 AS code FROM points")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    return Territory(spark, sf).points.select("id", S.morton_parent(S.morton_code("x", "y"), 3).alias("code"))


@query(
    "h4_projection",
    """, l AS (SELECT id, x / 10007.0::DOUBLE * 360 - 180 AS lon, y / 10009.0::DOUBLE * 170 - 85 AS lat FROM points)
  SELECT id, round(radians(lon) * 6378137.0, 3) AS mx, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 3) AS my, round(lon, 6) AS lon, round(lat, 6) AS lat FROM l""",
)
def h4(spark: SparkSession, sf: str) -> DataFrame:
    p = Territory(spark, sf).points.selectExpr("id", "x / 10007.0D * 360 - 180 as lon0", "y / 10009.0D * 170 - 85 as lat0").withColumn("m", S.lonlat_to_mercator("lon0", "lat0")).withColumn("l", S.mercator_to_lonlat("m.x", "m.y"))
    return p.selectExpr("id", "round(m.x, 3) as mx", "round(m.y, 3) as my", "round(l.lon, 6) as lon", "round(l.lat, 6) as lat")


@query("h5_ring_measures", " SELECT blockid, 1.0::DOUBLE AS area, 4.0::DOUBLE AS length, cx + 0.5::DOUBLE AS x, cy + 0.5::DOUBLE AS y, cx::DOUBLE AS minx, (cy + 1)::DOUBLE AS maxy, 5 AS n FROM blocks")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.col("ring")
    rows = Territory(spark, sf).block_rings.select("blockid", R.ring_area(ring).alias("area"), R.ring_length(ring).alias("length"), R.ring_centroid(ring).alias("c"), R.ring_bbox(ring).alias("b"), R.ring_points(ring).alias("n"))
    return rows.selectExpr("blockid", "area", "length", "round(c.x, 6) as x", "round(c.y, 6) as y", "b.minx", "b.maxy", "n")


@query(
    "h6_geo_distance",
    """, l AS (SELECT id, x / 10007.0::DOUBLE * 360 - 180 AS lon, y / 10009.0::DOUBLE * 170 - 85 AS lat FROM points)
  SELECT id, round(2 * 6371008.8 * asin(sqrt(pow(sin((0.5::DOUBLE - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(0.5::DOUBLE) * pow(sin(radians(10 - lon) / 2), 2))), 2) AS dist FROM l""",
)
def h6(spark: SparkSession, sf: str) -> DataFrame:
    p = Territory(spark, sf).points.selectExpr("id", "x / 10007.0D * 360 - 180 as lon", "y / 10009.0D * 170 - 85 as lat")
    return p.select("id", F.round(S.geo_distance("lon", "lat", F.lit(10.0), F.degrees(F.lit(0.5))), 2).alias("dist"))


VECTORS = "id", "cast(x as double) as x", "cast(y as double) as y", "cast(owner - 12 as double) as dx", "cast(id % 9 - 4 as double) as dy"
VECTOR_SQL = ", v AS (SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, (owner - 12)::DOUBLE AS dx, (id % 9 - 4)::DOUBLE AS dy FROM points)"


@query(
    "h7_closest_point_on_segment",
    VECTOR_SQL
    + """, w AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(least(((x - 5000) * dx * 100 + (y - 5000) * dy * 100) / (dx * dx * 10000 + dy * dy * 10000), 1), 0) END AS t FROM v)
  SELECT id, round(5000 + t * dx * 100, 4) AS cx, round(5000 + t * dy * 100, 4) AS cy, round(sqrt(pow(5000 + t * dx * 100 - x, 2) + pow(5000 + t * dy * 100 - y, 2)), 4) AS dist FROM w""",
)
def h7(spark: SparkSession, sf: str) -> DataFrame:
    v = Territory(spark, sf).points.selectExpr(*VECTORS)
    c = S.closest_point_on_segment("x", "y", F.lit(5000.0), F.lit(5000.0), 5000 + F.col("dx") * 100, 5000 + F.col("dy") * 100)
    return v.select("id", c.alias("c")).selectExpr("id", "round(c.x, 4) as cx", "round(c.y, 4) as cy", "round(c.dist, 4) as dist")


@query("h8_planar_distance", " SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE round(sqrt(((x - 5000) * (x - 5000) + (y - 5000) * (y - 5000))::DOUBLE), 6) END AS dist FROM points")
def h8(spark: SparkSession, sf: str) -> DataFrame:
    return Territory(spark, sf).points.select("id", F.round(S.planar_distance(F.lit(5000), F.lit(5000), F.when(F.col("id") % 5 != 0, F.col("x")), "y"), 6).alias("dist"))


TURN_SQL = ", d AS (SELECT *, atan2(y - 5000, x - 5000) - atan2(dy, dx) AS turn, (dx = 0 AND dy = 0) OR (x = 5000 AND y = 5000) AS zero FROM v)"


@query(
    "h9_angle_delta",
    VECTOR_SQL
    + TURN_SQL
    + """ SELECT id, CASE WHEN zero THEN NULL ELSE round(CASE WHEN turn > pi() THEN turn - 2 * pi() WHEN turn < -pi() THEN turn + 2 * pi() ELSE turn END, 6) END AS near,
  CASE WHEN zero THEN NULL ELSE round(CASE WHEN id % 2 = 0 AND turn > 0 THEN turn - 2 * pi() WHEN id % 2 = 1 AND turn < 0 THEN turn + 2 * pi() ELSE turn END, 6) END AS forced FROM d""",
)
def h9(spark: SparkSession, sf: str) -> DataFrame:
    v = Territory(spark, sf).points.selectExpr(*VECTORS, "case when id % 2 = 0 then -1 else 1 end as sign")
    args = ("dx", "dy", F.col("x") - 5000, F.col("y") - 5000)
    return v.select("id", F.round(S.angle_delta(*args), 6).alias("near"), F.round(S.angle_delta(*args, sign="sign"), 6).alias("forced"))


ALONG_SQL = "CASE WHEN dx = 0 AND dy = 0 THEN sqrt(pow(x - 5000, 2) + pow(y - 5000, 2)) ELSE (dx * (x - 5000) + dy * (y - 5000)) / sqrt(dx * dx + dy * dy) END"


@query("h10_along_distance", VECTOR_SQL + f" SELECT id, round({ALONG_SQL}, 4) AS along FROM v")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    v = Territory(spark, sf).points.selectExpr(*VECTORS)
    return v.select("id", F.round(S.along_distance("x", "y", F.lit(5000.0), F.lit(5000.0), "dx", "dy"), 4).alias("along"))


@query(
    "h11_edge_score",
    VECTOR_SQL
    + TURN_SQL
    + f""", e AS (SELECT *, CASE id % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 END AS s FROM d), f AS (SELECT *, s * CASE WHEN s < 0 AND turn > 0 THEN turn - 2 * pi() WHEN s > 0 AND turn < 0 THEN turn + 2 * pi() ELSE turn END - 1.5 * pi() AS raw FROM e)
  SELECT id, round(CASE WHEN s IS NULL THEN {ALONG_SQL} WHEN zero THEN NULL WHEN raw < -pi() THEN raw + 2 * pi() ELSE raw END, 4) AS score FROM f""",
)
def h11(spark: SparkSession, sf: str) -> DataFrame:
    v = Territory(spark, sf).points.selectExpr(*VECTORS, "case id % 3 when 0 then -1 when 1 then 1 end as sign")
    return v.select("id", F.round(S.edge_score("x", "y", F.lit(5000.0), F.lit(5000.0), "dx", "dy", "sign"), 4).alias("score"))


@query("h12_strict_int", " SELECT id, CASE id % 4 WHEN 0 THEN x END AS value FROM points")
def h12(spark: SparkSession, sf: str) -> DataFrame:
    text = "case id % 4 when 0 then cast(x as string) when 1 then concat('0', x) when 2 then concat(x, '.5') else concat(' ', x) end as text"
    return Territory(spark, sf).points.selectExpr("id", text).select("id", S.strict_int("text").alias("value"))


@query("h13_text_set", " SELECT blockid, substr(lpad(blockid::VARCHAR, 8, '0'), 1, 5) || '-' || stateid AS code, format('{:,}', population * 1000) AS people, (stateid = 1) AS first FROM blocks")
def h13(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws("-", F.substring(F.lpad(F.col("blockid").cast("string"), 8, "0"), 1, 5), F.trim(F.regexp_extract(F.concat(F.lit("S "), F.col("stateid").cast("string"), F.lit(" ")), "[0-9]+", 0)))
    return Territory(spark, sf).blocks.select("blockid", text.alias("code"), S.thousands(F.col("population") * 1000).alias("people"), F.concat(F.lit("STATE"), F.col("stateid").cast("string")).ilike("%e1").alias("first"))


@query("h14_array_set", " SELECT id, (owner % 3 = id % 3) AS seen, owner % 3 + id % 3 * 10 AS coded FROM points")
def h14(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.array(F.col("owner") % 3), F.array(F.col("id") % 3))
    return Territory(spark, sf).points.select("id", F.array_contains(F.slice(path, 1, 1), F.element_at(path, 2)).alias("seen"), (F.get(path, F.lit(0)) + F.get(path, F.lit(1)) * 10).alias("coded"))


@query("h15_conditional_set", " SELECT wsid, coalesce(parentid, 0) AS parent, least(wx, wy) AS low, greatest(wx, wy) AS high, CASE WHEN parentid IS NULL THEN 'root' ELSE 'node' END AS kind FROM watersheds")
def h15(spark: SparkSession, sf: str) -> DataFrame:
    return Territory(spark, sf).watersheds.select("wsid", F.coalesce("parentid", F.lit(0)).alias("parent"), F.least("wx", "wy").alias("low"), F.greatest("wx", "wy").alias("high"), F.when(F.col("parentid").isNull(), "root").otherwise("node").alias("kind"))


@query("h16_orient_clockwise", " SELECT blockid, -1.0::DOUBLE AS area FROM blocks")
def h16(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.when(F.col("blockid") % 2 == 0, F.reverse("ring")).otherwise(F.col("ring"))
    return Territory(spark, sf).block_rings.select("blockid", R.signed_area(R.orient_clockwise(ring)).alias("area"))


PAIR_SQL = """, s AS (SELECT id, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + owner * 40 - 400)::DOUBLE AS x1, (y + (id % 21) * 40 - 400)::DOUBLE AS y1 FROM points),
  p AS (SELECT id, x0 AS ax0, y0 AS ay0, x1 AS ax1, y1 AS ay1, x0 + 100 AS bx0, y0 - 30 AS by0, x0 - 100 + id % 7 * 10 AS bx1, y0 + 60 AS by1 FROM s),
  q AS (SELECT *, (ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0) AS d, (bx0 - ax0) * (by1 - by0) - (by0 - ay0) * (bx1 - bx0) AS tn, (bx0 - ax0) * (ay1 - ay0) - (by0 - ay0) * (ax1 - ax0) AS un FROM p)"""


@query("h18_segment_intersection", PAIR_SQL + " SELECT id, round(ax0 + tn / d * (ax1 - ax0), 4) AS x, round(ay0 + tn / d * (ay1 - ay0), 4) AS y FROM q WHERE d <> 0 AND tn / d BETWEEN 0 AND 1 AND un / d BETWEEN 0 AND 1")
def h18(spark: SparkSession, sf: str) -> DataFrame:
    s = Territory(spark, sf).points.selectExpr("id", "cast(x as double) as x0", "cast(y as double) as y0", "cast(x + owner * 40 - 400 as double) as x1", "cast(y + (id % 21) * 40 - 400 as double) as y1")
    b = s.selectExpr("id", "x0 + 100 as bx0", "y0 - 30 as by0", "x0 - 100 + id % 7 * 10 as bx1", "y0 + 60 as by1")
    cross = S.segment_intersection(("x0", "y0", "x1", "y1"), ("bx0", "by0", "bx1", "by1"))
    return s.join(b, "id").select("id", cross.alias("p")).filter("p is not null").selectExpr("id", "round(p.x, 4) as x", "round(p.y, 4) as y")


@query("h19_midpoint", " SELECT id, (x + 100) / 2.0::DOUBLE AS mx, (y + 7) / 2.0::DOUBLE AS my FROM points")
def h19(spark: SparkSession, sf: str) -> DataFrame:
    return Territory(spark, sf).points.select("id", S.midpoint("x", "y", F.lit(100), F.lit(7)).alias("m")).selectExpr("id", "m.x as mx", "m.y as my")
