"""Image folders, JSON records and tabular sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Image extensions.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def images(spark: SparkSession, path: str, recursive: bool = False, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, stem, size_bytes, sha256, duplicate): image files, in the order of their lower-case names; `duplicate` marks
    stems that several files share, which callers must refuse."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions))
    stem = F.lower(F.regexp_extract(name, r"^(.*)\.[^.]+$", 1))
    out = f.select("path", stem.alias("stem"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return out.withColumn("duplicate", F.count("*").over(Window.partitionBy("stem")) > 1).orderBy("stem")


def building_of(stem: Column) -> Column:
    """The id with which a file name begins, for association in batches only."""
    return F.regexp_extract(stem, r"^(\d+)(?:_|$)", 1)


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """Views of complete gallery indexes, one row each; an index that is not complete or has no views gives none."""
    g = spark.read.option("multiLine", True).json(path)
    return g.where((F.col("status") == "complete") & (F.size("views") > 0)).select(F.explode("views").alias("v")).select("v.*")


def latest(runs: DataFrame, key: str, started: str = "started_at", complete_only: bool = False) -> DataFrame:
    """The newest run of each key; with complete_only, the newest that is complete."""
    r = runs.where("status = 'complete'") if complete_only else runs
    return r.groupBy(key).agg(F.max_by("run_dir", started).alias("run_dir"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; numbers that are not finite become null."""
    doubles = {c for c, k in df.dtypes if k in ("double", "float")}
    df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns with a header; blank for null and what is not finite."""
    doubles = {c for c, k in df.dtypes if k in ("double", "float")}
    df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in doubles else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)
