"""Work that must not grow with what cannot count, and rewritten searches against plain ones."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from terrajobs import plans
from terrajobs.operators import joins, shapes, summaries


def test_small_boxes_do_not_meet_in_cells_of_large_ones(spark):
    small = spark.range(400).selectExpr("id", "cast(id % 20 as double) as minx", "cast(id div 20 as double) as miny", "id % 20 + 0.5D as maxx", "id div 20 + 0.5D as maxy")
    large = spark.range(1).selectExpr("-1L as id", "0D as minx", "0D as miny", "30D as maxx", "30D as maxy")
    both = small.union(large)
    levels = spark.range(1).selectExpr("array(0, 5) as _levels")
    cells = [joins._in_cells(both, s, levels, 1.0) for s in "01"]
    keys = [c for c in cells[0].columns if c.startswith("_") and c in cells[1].columns]
    assert cells[0].join(cells[1], keys).count() == 400 + 400 + 400 + 1  # 160000 more before
    assert joins.bbox_join(both, both, 1.0).count() == 400 + 400 + 400 + 1


def test_distances_stay_out_of_the_join(spark):
    rng = random.Random(5)
    rows = [(i, *(rng.uniform(0, 40) for _ in range(4))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    near = joins.near_crossings(df, 8.0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert not any("SQRT" in line for line in plan.split("\n") if "Join Inner" in line)
    want = {tuple(r) for r in joins.segment_pairs(df, df, 8.0, 1e-5).filter("a_id < b_id").filter(joins.segment_distance(joins._A, joins._B) <= 1e-5).select("a_id", "b_id").collect()}
    assert len(want) > 1000 and {tuple(r) for r in near.select("a_id", "b_id").collect()} == want


def test_ties_of_ends_equal_those_of_all_pairs(spark):
    rng = random.Random(9)
    spot = lambda: (float(rng.randrange(12)) + rng.choice([0, 0, 0.02, 0.03]), float(rng.randrange(12)))
    rows = [(i, rng.choice([None, 1, 2, 3, 4]), *spot(), *spot()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, owner long, x0 double, y0 double, x1 double, y1 double")
    ends = df.selectExpr("id", "owner", "x0 as x", "y0 as y").union(df.selectExpr("id", "owner", "x1 as x", "y1 as y"))
    want = joins.mutual_nearest(joins.within_distance(ends, ends, 0.05, distinct_owner=True, positive=True)).select("x0", "y0", "x1", "y1")
    got = [tuple(r) for r in shapes._ties_of_ends(df, 0.05).collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) > 20
    assert shapes._ties_of_ends(df.limit(0), 0.05).count() == 0


def crowd(spark, owners=5):
    """A dense crowd, an even spread, and a few points far from all but one another."""
    rng = random.Random(11)
    spots = [(rng.randrange(9) / 8, rng.randrange(9) / 8) for _ in range(200)] + [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(150)]
    rows = [(i, rng.choice([*range(owners), None] if i % 9 == 0 else range(owners)), float(x), float(y)) for i, (x, y) in enumerate([*spots, (90.0, 90.0), (96.0, 90.0), (500.0, 0.0)])]
    return spark.createDataFrame(rows, "id long, owner long, x double, y double")


def test_nearest_pairs_equal_the_least_of_all(spark):
    df = crowd(spark)
    for a, per, d, other in ((df, ["id0"], 8.0, True), (df, ["owner0"], 8.0, True), (df, ["x0", "y0"], 3.0, False), (df.filter("id % 7 = 0"), ["id0"], 20.0, True)):
        everything = [r.asDict() for r in joins.within_distance(a, df, d, other).collect()]
        least = {}
        for r in everything:
            key = tuple(r[c] for c in per)
            least[key] = min(least.get(key, d), r["dist"])
        want = sorted((r["id0"], r["id1"]) for r in everything if r["dist"] == least[tuple(r[c] for c in per)])
        got = sorted((r.id0, r.id1) for r in joins.nearest_pairs(a, df, d, per, other).collect())
        assert got == want and len(want) > 10 - 5 * (per == ["owner0"])
    assert joins.nearest_pairs(df.limit(0), df, 8.0, ["id0"]).count() == joins.nearest_pairs(df, df.limit(0), 8.0, ["id0"]).count() == 0


def test_nearest_links_equal_the_least_of_all(spark):
    for owners in (5, 60):
        df = crowd(spark, owners)
        everything = [r.asDict() for r in joins.within_distance(df, df, 8.0).collect()]
        least = {}
        for r in everything:
            key = frozenset((r["owner0"], r["owner1"]))
            least[key] = min(least.get(key, 8.0), r["dist"])
        want = sorted((r["id0"], r["id1"]) for r in everything if r["dist"] == least[frozenset((r["owner0"], r["owner1"]))])
        assert sorted((r.id0, r.id1) for r in joins.nearest_links(df, 8.0).collect()) == want and len(want) > 10
    assert joins.nearest_links(df.limit(0), 8.0).count() == 0


def test_nearest_ties_of_equal_ids(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 100, 0), (3, 0, 9)], "id long, x long, y long")
    ties = spark.createDataFrame([(1, 0, 4), (5, 0, -4), (2, 100, 31)], "tieid long, x long, y long")
    got = {(r.id, r.tieid, r.dist) for r in summaries.assign_nearest_tie(points, ties, 30.0).collect()}
    assert got == {(1, 1, 4.0), (3, 1, 5.0)}


@pytest.mark.parametrize("name", ["d2_tile_rollup", "d2_tile_outlines"])
def test_tiles_of_many_rows_match_sql(spark, sf_dir, tmp_path, name):
    """Blocks in more rows than the ten bits of a place that the SQL's codes have."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").limit(150).selectExpr("p_partkey", "p_size")
    part.unionByName(part.selectExpr("p_partkey + 40 * 1023", "p_size").toDF("p_partkey", "p_size")).unionByName(part.selectExpr("p_partkey + 40 * 1024", "p_size").toDF("p_partkey", "p_size")).dropDuplicates(["p_partkey"]).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(map(float, r)) for r in got.collect()) == sorted(tuple(map(float, r)) for r in want.fetchall())
