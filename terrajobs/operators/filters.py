"""Projections and predicates over territorial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrajobs.functions.rings import orient_clockwise, ring_centroid, without_repeats
from terrajobs.functions.scalars import MAP_WIDTH
from terrajobs.operators.ordering import with_dense_id


def apply_link_fixes(df: DataFrame, fixes: DataFrame, code: str = "code", to: str = "tocode") -> DataFrame:
    """Overwrite ``to`` for the codes listed in ``fixes`` (code, tocode)."""
    new = fixes.select(F.col("code").alias("_code"), F.col("tocode").alias("_to"))
    return df.join(new, F.col(code) == F.col("_code"), "left").withColumn(to, F.coalesce("_to", to)).drop("_code", "_to")


def uniquify_codes(df: DataFrame, code: str = "code", keep: int = 10, id_col: str = "id") -> DataFrame:
    """Rows whose code is shared get their first ``keep`` characters and 99 - n.

    n is a serial over all such rows, in order of (code, id); codes that are unique stay.
    """
    shared = df.groupBy(code).agg(F.count("*").alias("_n")).filter("_n > 1").select(code)
    twice = with_dense_id(df.join(shared, code, "left_semi").select(id_col, code), [code, id_col], "_serial")
    new = twice.select(F.col(id_col).alias("_id"), F.concat(F.substring(code, 1, keep), (99 - F.col("_serial")).cast("string")).alias("_code"))
    return df.join(new, F.col(id_col) == F.col("_id"), "left").withColumn(code, F.coalesce("_code", code)).drop("_id", "_code")


def resolve_parents(df: DataFrame, code: str = "code", to_code: str = "tocode", id_col: str = "id") -> DataFrame:
    """Add ``parentid``: the row whose code equals ``to_code``. Links to itself, and words
    that name no row, give null."""
    up = df.select(F.col(code).alias("_code"), F.col(id_col).alias("parentid"))
    return df.join(up, (F.col(to_code) == F.col("_code")) & (F.col(id_col) != F.col("parentid")), "left").drop("_code")


def wrap_antimeridian(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Move rings whose centroid lies east of 0 one map width west."""
    moved = F.transform(ring, lambda p: F.struct((p["x"] - MAP_WIDTH).alias("x"), p["y"].alias("y")))
    return df.withColumn(ring, F.when(ring_centroid(F.col(ring))["x"] > 0, moved).otherwise(F.col(ring)))


def polygon_parts(df: DataFrame, polygons: str = "polygons") -> DataFrame:
    """Outer rings of multipolygons, one row each with its ``part``.

    ``polygons`` is array<array<ring>>, the first ring of each being its outline. Holes go,
    so do points equal to the one before; rings of more than three points stay, clockwise.
    """
    rows = df.select(*[c for c in df.columns if c != polygons], F.posexplode(polygons).alias("part", "_rings"))
    ring = without_repeats(F.get("_rings", F.lit(0)))
    return rows.withColumn("ring", orient_clockwise(ring)).drop("_rings").filter(F.size("ring") > 3)


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Boxes (minx, miny, maxx, maxy) that touch or overlap."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def filter_bbox(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose minx, miny, maxx, maxy meet a constant window."""
    return df.filter(boxes_overlap(tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), tuple(F.lit(float(v)) for v in box)))


def filter_features(df: DataFrame, types: list[str], names: list[str], box: tuple[float, float, float, float], name_cols: tuple[str, ...] = ("name1", "name2", "name3")) -> DataFrame:
    """Rows of a type (pattern, any case), or with a listed name in any name column, that
    meet the window."""
    wanted = F.lit(False)
    for t in types:
        wanted = wanted | F.col("type").ilike(t)
    for c in name_cols:
        wanted = wanted | F.coalesce(F.col(c).isin(names), F.lit(False))
    return filter_bbox(df.filter(wanted), box)


def filter_flow_class(df: DataFrame, prefixes: list[str], code: str = "fcode") -> DataFrame:
    """Rows whose flow code starts with a listed prefix, with its ``class`` (code div 100)."""
    return df.filter(F.substring(F.col(code).cast("string"), 1, 3).isin(prefixes)).withColumn("class", F.expr(f"`{code}` div 100"))


def tag_border_members(df: DataFrame, codes: list[str], column: str = "states") -> DataFrame:
    """Add ``border``: a multi-valued text holds one of the codes, in any case."""
    found = F.lit(False)
    for c in codes:
        found = found | F.coalesce(F.col(column).ilike(f"%{c}%"), F.lit(False))
    return df.withColumn("border", found)


def drop_degenerate(segments: DataFrame) -> DataFrame:
    """Segments of positive length."""
    return segments.filter("not (x0 = x1 and y0 = y1)")


def select_states(states: DataFrame, name: str = "all") -> DataFrame:
    """States with representatives, and their district size, rounded half to even."""
    chosen = states.filter("representatives > 0")
    if name != "all":
        chosen = chosen.filter(F.col("name").ilike(name))
    return chosen.withColumn("districtsize", F.rint(F.col("population").cast("double") / F.col("representatives")).cast("long")).orderBy("name")


def pooled_territory(blocks: DataFrame, tally: DataFrame, reps: DataFrame, seats: int = 435, name: str = "USA") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All states as one: blocks keep ``originalstateid``, tally and seats get one row more."""
    pooled = blocks.withColumn("originalstateid", F.col("stateid")).withColumn("stateid", F.lit(1).cast(blocks.schema["stateid"].dataType))
    spark = blocks.sparkSession
    more = tally.select("name", "stateid").unionByName(spark.range(1).select(F.lit(name).alias("name"), F.lit(1).cast(tally.schema["stateid"].dataType).alias("stateid")))
    total = blocks.agg(F.sum("population").cast("long").alias("population")).select(F.lit(name).alias("state"), "population", F.lit(seats).alias("representatives"))
    return pooled, more, reps.select("state", F.col("population").cast("long").alias("population"), "representatives").unionByName(total)


def add_missing_seats(reps: DataFrame, tally: DataFrame, blocks: DataFrame, names: list[str]) -> DataFrame:
    """A row (name, summed population, 1) for each listed state of the tally."""
    per_state = blocks.groupBy("stateid").agg(F.sum("population").cast("long").alias("population"))
    new = tally.filter(F.col("name").isin(names)).join(per_state, "stateid").select(F.col("name").alias("state"), "population", F.lit(1).alias("representatives"))
    return reps.select("state", F.col("population").cast("long").alias("population"), "representatives").unionByName(new)


def serial_within(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
