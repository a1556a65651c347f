"""Territorial tables derived from the driver's tables by integer arithmetic.

The driver's tables hold no geometry. ``part`` becomes a grid of unit blocks over two
states with gaps, and shifted 4 x 4 watersheds in a flow forest; ``customer`` becomes
points; ``orders`` becomes a forest of deep chains. Their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Territory:
    """The derived tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def blocks(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", F.col("p_size").alias("population"))
        return (
            p.filter("p_partkey % 40 not in (9, 29) and (p_partkey div 40) % 17 <> 16")
            .selectExpr("p_partkey as blockid", "p_partkey % 40 as cx", "p_partkey div 40 as cy", "(p_partkey % 40) div 20 + 1 as stateid", "cast(population as int) as population")
        )

    @property
    def segments(self) -> DataFrame:
        sides = "stack(4, 1, cx, cy, cx, cy + 1, 2, cx, cy + 1, cx + 1, cy + 1, 3, cx + 1, cy + 1, cx + 1, cy, 4, cx + 1, cy, cx, cy) as (ordinal, x0, y0, x1, y1)"
        return self.blocks.selectExpr("blockid", "stateid", sides)

    @property
    def edges(self) -> DataFrame:
        from terrajobs.operators.joins import match_reversed_segments

        return match_reversed_segments(self.segments, "blockid", outside=-1).filter("neighbor >= 0").select(F.col("blockid").alias("blockid0"), F.col("neighbor").alias("blockid1"), "stateid")

    @property
    def watersheds(self) -> DataFrame:
        w = self.raw("part").selectExpr("(p_partkey div 160) * 10 + (p_partkey % 40) div 4 as wsid", "(p_partkey % 40) div 4 as wx", "p_partkey div 160 as wy").distinct()
        return w.selectExpr(
            "wsid",
            "wx",
            "wy",
            "wx div 5 + 1 as stateid",
            "case when wx % 5 <> 0 then wsid - 1 when wy % 3 <> 0 then wsid - 10 end as parentid",
            "4 * wx + 0.3D as minx",
            "4 * wy + 0.3D as miny",
            "4 * wx + 4.3D as maxx",
            "4 * wy + 4.3D as maxy",
        )

    @property
    def points(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey as id", "c_nationkey as owner", "c_custkey * 7919 % 10007 as x", "c_custkey * 104729 % 10009 as y")

    @property
    def forest(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey as id", "case when o_orderkey % 500 <> 0 then o_orderkey - 1 end as parentid", "o_orderkey % 7 as weight")

    @property
    def block_rings(self) -> DataFrame:
        """Blocks with their clockwise ring of five points."""
        point = lambda dx, dy: f"named_struct('x', cast(cx + {dx} as double), 'y', cast(cy + {dy} as double))"
        ring = ", ".join(point(*d) for d in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0)))
        return self.blocks.selectExpr("blockid", "stateid", "population", f"array({ring}) as ring")


PRELUDE = """
WITH RECURSIVE blocks AS (
  SELECT p_partkey AS blockid, p_partkey % 40 AS cx, p_partkey // 40 AS cy, (p_partkey % 40) // 20 + 1 AS stateid, p_size AS population
  FROM part WHERE p_partkey % 40 NOT IN (9, 29) AND (p_partkey // 40) % 17 <> 16),
segments AS (
  SELECT blockid, stateid, 1 AS ordinal, cx AS x0, cy AS y0, cx AS x1, cy + 1 AS y1 FROM blocks
  UNION ALL SELECT blockid, stateid, 2, cx, cy + 1, cx + 1, cy + 1 FROM blocks
  UNION ALL SELECT blockid, stateid, 3, cx + 1, cy + 1, cx + 1, cy FROM blocks
  UNION ALL SELECT blockid, stateid, 4, cx + 1, cy, cx, cy FROM blocks),
edges AS (
  SELECT a.blockid AS blockid0, b.blockid AS blockid1, a.stateid
  FROM segments a JOIN segments b ON a.x0 = b.x1 AND a.y0 = b.y1 AND a.x1 = b.x0 AND a.y1 = b.y0 AND a.stateid = b.stateid),
watersheds AS (
  SELECT wsid, wx, wy, wx // 5 + 1 AS stateid, CASE WHEN wx % 5 <> 0 THEN wsid - 1 WHEN wy % 3 <> 0 THEN wsid - 10 END AS parentid,
    (4 * wx + 0.3)::DOUBLE AS minx, (4 * wy + 0.3)::DOUBLE AS miny, (4 * wx + 4.3)::DOUBLE AS maxx, (4 * wy + 4.3)::DOUBLE AS maxy
  FROM (SELECT DISTINCT (p_partkey // 160) * 10 + (p_partkey % 40) // 4 AS wsid, (p_partkey % 40) // 4 AS wx, p_partkey // 160 AS wy FROM part)),
points AS (SELECT c_custkey AS id, c_nationkey AS owner, c_custkey * 7919 % 10007 AS x, c_custkey * 104729 % 10009 AS y FROM customer),
forest AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 500 <> 0 THEN o_orderkey - 1 END AS parentid, o_orderkey % 7 AS weight FROM orders)
"""
