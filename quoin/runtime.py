"""Sessions, and the shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession

HOME = Path(__file__).resolve().parent
ARROW_BYTES = str(2 << 20)
"""Arrow batches are bounded by bytes, as rows may be long."""
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the workers of this application the package, once; Spark's file server spreads it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        path = Path(tempfile.mkdtemp(prefix="quoin-")) / "quoin_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(HOME.rglob("*.py")):
                z.write(p, p.relative_to(HOME.parent))
        spark.sparkContext.addPyFile(str(path))
    return spark


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset and all runs on one machine, as in tests, a folder in the warehouse is used."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the shared folder: computed once, its lineage ends there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint(eager=True)


_taken: list[tuple] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder by columns and compressed, and read again: its lineage ends there, and the shuffles
    that it came from are freed. The table is dropped when the driver's Python ends, as results may still read it."""
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _taken:
        atexit.register(_drop_taken)
    _taken.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def _drop_taken() -> None:
    for path, conf in _taken:
        try:
            path.getFileSystem(conf).delete(path, True)
        except (Py4JError, OSError):  # the JVM has gone before
            return


def dealt(df: DataFrame, *by: Column | str) -> DataFrame:
    """df in as many partitions as a shuffle has, by some columns or evenly. Few and small files, whose rows become many or are
    worked hard, would be few tasks; with a stated number, small partitions are not put together again."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quoin")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
