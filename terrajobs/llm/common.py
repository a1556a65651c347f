"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 1 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(df: DataFrame, column: str, ids: DataFrame, id_column: str = "id", slots: int = SLOTS) -> DataFrame:
    """Rows of ``df`` that may have ``column`` among ``ids``: all that have it, and a few more.

    Only hash slots are broadcast, at most ``slots`` numbers however many ids there are, so
    wide rows are dropped before any shuffle. A join on the id itself must follow.
    """
    return _by_slot(df, column, ids, id_column, slots, "left_semi")


def _by_slot(df: DataFrame, column: str, ids: DataFrame, id_column: str, slots: int, how: str) -> DataFrame:
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(slots)).cast("int")
    wanted = ids.filter(F.col(id_column).isNotNull()).select(slot(id_column).alias("slot")).distinct()
    return df.select(slot(column).alias("slot"), F.struct("*").alias("row")).join(F.broadcast(wanted), "slot", how).select("row.*")


def split_by_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str = "id", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have ``column`` among ``ids``, rows that certainly have not): only the
    first part needs a shuffle. Rows of a null column are in the second part."""
    absent = _by_slot(df.filter(F.col(column).isNotNull()), column, ids, id_column, slots, "left_anti")
    return narrowed(df.filter(F.col(column).isNotNull()), column, ids, id_column, slots), absent.unionByName(df.filter(F.col(column).isNull()))


def without_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``ids``; rows of a null column stay."""
    maybe, rest = split_by_ids(df, column, ids, id_column)
    maybe = maybe.select(F.col(column).alias("key"), F.struct("*").alias("row"))
    return maybe.join(ids.select(F.col(id_column).alias("key")), "key", "left_anti").select("row.*").unionByName(rest)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session passes at most ``BATCH_ROWS`` rows to Python at a time. Whole
    texts are wide, and Spark's default of 10,000 would hold tens of MB of them in every
    buffer on the way; a smaller setting of the session's own stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, after which a worker gives its spare memory back:
    a worker that is used again would else keep what its largest task took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task
