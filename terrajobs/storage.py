"""Lineage cuts: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``. Where that is unset a temporary one serves a local
    session; on a cluster it is an error, since executors could not read each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="terrajobs-")
    return _own[app]


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut
    that survives lost executors and that the optimizer knows the size of."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stashed tables that nothing still reads."""
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
