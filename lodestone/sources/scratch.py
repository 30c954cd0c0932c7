"""Tables that cut a long lineage, written to the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else SparkContext.setCheckpointDir's. With neither, a local master (tests) gets
    one below the warehouse; a cluster raises, as its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = told.get() if told.isDefined() else None
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def scratch(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; it outlives lost executors, and goes when the driver ends, or
    by forget()."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lodestone/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table that scratch() has returned and that no later one reads; others are left alone."""
    path = getattr(df, "_scratch", None)
    if path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; what stays is only scratch
            return
