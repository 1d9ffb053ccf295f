"""What the operators share: keys of texts, folders that all executors see, sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
"""Text that one Python call works on."""


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of df has (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> list[Column]:
    """128 bits of the SHA-256 of a text as two longs; null has a key of its own."""
    digest = F.sha2(text.cast("string").cast("binary"), 256)
    return [F.coalesce(F.conv(F.substring(digest, at, 16), 16, -10).cast("long"), F.lit(0).cast("long")) for at in (1, 17)]


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it is unset and all runs on one machine, as in tests, one in the
    warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_taken: list[tuple] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, as results may still read it dropped only when the driver's Python ends;
    `discard` drops it before."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _taken:
        atexit.register(_drop_taken)
    _taken.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))
    return path


def _drop_taken() -> None:
    for path, conf in _taken:
        try:
            path.getFileSystem(conf).delete(path, True)
        except (Py4JError, OSError):  # the JVM has gone before
            return


def discard(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more: it learns of these only when the driver
    collects garbage, which a driver with free memory puts off while the executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column: one pass over that column. Only sizes of parts depend on it, never results."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_of(docs: DataFrame, text: str, per: int, least: int = 1) -> int:
    """How many parts of about `per` bytes a text column has."""
    return max(least, -(-text_bytes(docs, text) // per))


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
