"""Intermediate tables in the folder that all machines share, and Arrow batches that workers can hold."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch brings to a worker; a longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 22


def stored(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df by way of the shared folder, so that what reads it twice doesn't compute it twice and a lost executor costs nothing. The table goes when the application ends. rows: of a file, at most, if any."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/duplet-checkpoints"
    path = f"{folder}/duplet/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes what stored() wrote for each frame; none may be read again."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs, whose frames nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
    """df.mapInArrow(run, fields) with batches of BATCH_ROWS and BATCH_BYTES at most. Workers give memory back when a task ends.

    Frames are lazy, so the two settings of the session must hold until the caller acts: they are only ever lowered, and stay so.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)

    def freed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim is not None:
            trim(0)

    return df.mapInArrow(freed, fields)
