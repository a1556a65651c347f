"""Readers of the tally, apportionment and block tables, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrajobs.functions.scalars import thousands
from terrajobs.operators.ordering import with_dense_id

TALLY_SCHEMA = "fips string, name string, blocks2010 string, blocks2000 string, change string, percent string"
APPORTIONMENT_SCHEMA = "state string, population string, representatives int"


def read_block_tally(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tally, all text. ``stateid`` is the first run of digits of the first
    column; rows without one (header, national total, spacer) go; names are trimmed."""
    raw = spark.read.csv(path, sep="\t", schema=TALLY_SCHEMA)
    digits = F.nullif(F.regexp_extract("fips", "[0-9]+", 0), F.lit(""))
    return raw.withColumn("stateid", digits.cast("int")).withColumn("name", F.trim("name")).filter("stateid is not null")


def read_apportionment(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; rows without representatives go."""
    return spark.read.csv(path, header=True, schema=APPORTIONMENT_SCHEMA).filter("representatives is not null")


def read_block_parts(spark: SparkSession, paths: list[str], state_col: str = "statefp10") -> DataFrame:
    """Per-state Parquet parts as one table, ids dense from 1 in order of ``blockid10``."""
    parts = spark.read.parquet(*paths)
    rows = parts.withColumn("stateid", F.col(state_col).cast("int")).withColumn("population", F.col("pop10").cast("int")).drop(state_col, "pop10")
    return with_dense_id(rows, ["blockid10"], "id")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_district_blocks(assignment: DataFrame, blocks: DataFrame, path: str) -> DataFrame:
    """Write (districtid, blockid10) as CSV with a header in a folder per state, ordered.

    Rows are dealt by ranges, so a large state is written by several tasks, a file each; the
    files' rows follow one another."""
    rows = assignment.join(blocks, "blockid").select("stateid", "districtid", "blockid10")
    rows.repartitionByRange("stateid", "districtid", "blockid10").sortWithinPartitions("stateid", "districtid", "blockid10").write.mode("overwrite").partitionBy("stateid").csv(path, header=True)
    return rows


def placemark_rows(districts: DataFrame) -> DataFrame:
    """(stateid, districtid, part, line): label and outline text rows of districts.

    Takes stateid, districtid, population, x, y and ring. Part 0 opens a district, 1 is its
    label with thousands separators, 2 its centre, 3 its outline, 4 closes it.
    """
    ring = F.array_join(F.transform("ring", lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    lines = F.array(
        F.lit("<Folder>"),
        F.concat(F.lit("<name>District "), F.col("districtid").cast("string"), F.lit(": "), thousands("population"), F.lit("</name>")),
        F.concat(F.lit("<Point>"), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("</Point>")),
        F.concat(F.lit("<Polygon>"), ring, F.lit("</Polygon>")),
        F.lit("</Folder>"),
    )
    return districts.select("stateid", "districtid", F.posexplode(lines).alias("part", "line"))


def save_assignment(blocks: DataFrame, path: str) -> DataFrame:
    """Write only assigned blocks, as (id, districtid); returns what was written."""
    rows = blocks.filter("districtid is not null").select(F.col("blockid").alias("id"), "districtid")
    rows.write.mode("overwrite").parquet(path)
    return rows
