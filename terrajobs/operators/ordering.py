"""Ordering, top-1 and serial ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrajobs.functions.scalars import planar_distance
from terrajobs.storage import stash


def with_dense_id(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Serial ids in sorted order without bringing the rows into one partition.

    Rows are range-partitioned and sorted; each partition's row count gives the offset of
    the next. Only one (partition, count) row per partition meets in one task. Equal rows
    get consecutive ids in any order.
    """
    ranged = stash(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_dense_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_dense_part").agg(F.count("*").alias("_dense_n"))
    offsets = counts.select("_dense_part", (F.sum("_dense_n").over(Window.orderBy("_dense_part")) - F.col("_dense_n")).alias("_dense_offset"))
    rank = F.row_number().over(Window.partitionBy("_dense_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return ranged.withColumn("_dense_rank", rank).join(F.broadcast(offsets), "_dense_part").withColumn(name, (F.col("_dense_offset") + F.col("_dense_rank") - 1 + start).cast("long")).drop("_dense_part", "_dense_rank", "_dense_offset")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    """Add the sum of ``value`` over each key's rows up to the row's own, in the given order.

    Rows are range-partitioned by key and order, so a key of any size is spread over tasks;
    sums of each key's parts give what stands before the next. Only those sums, one for a
    key and partition, meet in a window.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = stash(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys] + [F.col(k).isNull().alias(f"_no_{k}") for k in keys]
    ids = ["_part", *(f"_{k}" for k in keys), *(f"_no_{k}" for k in keys)]
    ranged = ranged.select("*", *same)
    sums = ranged.groupBy(*ids).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*ids[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*ids, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*ids).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(offsets, ids).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop(*ids, "_before")


def best_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by the columns of ``order``, a minus before those that
    descend (numbers and booleans). Groups are aggregated before they are shuffled."""
    down = lambda c: -F.col(c[1:]).cast("int") if dict(df.dtypes)[c[1:]] == "boolean" else -F.col(c[1:])
    ranks = [(down(c) if c.startswith("-") else F.col(c)).alias(f"r{k}") for k, c in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*ranks)).alias("_best"))
    return best.select("_best.*")


def order_children(children: DataFrame) -> DataFrame:
    """Siblings in cyclic order after the parent's own exit interface.

    Takes parentid, id, ordinal (place of the child's interface on the parent's ring, null if
    it has none), start (place of the parent's exit, or of its coast) and area. Places before
    the start come round again; children without a place are last. Ties: larger area, id.
    """
    again = F.col("ordinal") <= F.col("start")  # null without a place or a start
    place = F.when(again.isNotNull(), F.col("ordinal"))
    w = Window.partitionBy("parentid").orderBy(again.asc_nulls_last(), place.asc_nulls_last(), F.col("area").desc(), "id")
    return children.withColumn("rank", F.row_number().over(w))


def rank_basin_links(links: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Rank links by (descent - boundary descent), descent, island area, length descending,
    then ids; takes those columns, wsid0 and wsid1. Without ``partition`` all links are
    ranked together, by ranges."""
    first, length = F.col("descent") - F.col("boundary_descent"), F.col("length")
    if partition:
        w = Window.partitionBy(*partition).orderBy(first, "descent", "island_area", length.desc(), "wsid0", "wsid1")
        return links.withColumn("rank", F.row_number().over(w))
    keyed = links.withColumns({"_inland": first, "_shortness": -length})
    return with_dense_id(keyed, ["_inland", "descent", "island_area", "_shortness", "wsid0", "wsid1"], "rank").drop("_inland", "_shortness")


def farthest_block(blocks: DataFrame, targets: DataFrame, key: str = "rootid") -> DataFrame:
    """(key, blockid, dist): the block farthest from its group's target; ties to the smallest id."""
    d = blocks.join(targets, key).withColumn("dist", planar_distance("x", "y", "tx", "ty"))
    best = d.groupBy(key).agg(F.max(F.struct("dist", (-F.col("blockid")).alias("neg"))).alias("b"))
    return best.select(key, (-F.col("b.neg")).alias("blockid"), F.col("b.dist").alias("dist"))


def largest_group(groups: DataFrame, keys: list[str], value: str = "population", group: str = "groupid") -> DataFrame:
    """The group of most population in each key; the smallest id on ties."""
    best = groups.groupBy(*keys).agg(F.max(F.struct(value, (-F.col(group)).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).alias(group), F.col(f"b.{value}").alias(value))


def first_unsnapped_district(neighbors: DataFrame) -> DataFrame:
    """(groupid, districtid): smallest neighbour district above the group's current one."""
    return neighbors.filter("neighbor > current").groupBy("groupid").agg(F.min("neighbor").alias("districtid"))


def sorted_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)
