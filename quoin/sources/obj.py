"""Wavefront OBJ: reading of faces, and lines for writing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACE = "path string, face int, corner int, x double, y double, z double"


def vertex_line(x: Column, y: Column, z: Column, digits: int = 9) -> Column:
    return F.format_string(f"v %.{digits}f %.{digits}f %.{digits}f", x, y, z)


def face_line(first: Column, n: int = 4) -> Column:
    """A face over n consecutive vertices, the first by its 1-based number."""
    return F.concat_ws(" ", F.lit("f"), *[(first + i).cast("string") for i in range(n)])


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """Corners of all faces of the OBJ files under path; negative numbers count back from the vertices read so far.

    A file is parsed as a whole by one task, as its numbers refer to lines before."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                vertices, rows, face = [], [], 0
                for line in bytes(data).decode("utf-8").splitlines():
                    parts = line.split()
                    if parts[:1] == ["v"]:
                        vertices.append([float(v) for v in parts[1:4]])
                    elif parts[:1] == ["f"]:
                        for c, ref in enumerate(parts[1:]):
                            i = int(ref.split("/")[0])
                            rows.append((p, face, c, *vertices[i - 1 if i > 0 else i]))
                        face += 1
                yield pd.DataFrame(rows, columns=["path", "face", "corner", "x", "y", "z"])

    return files.mapInPandas(parse, FACE)


def write_quads(quads: DataFrame, path: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), digits: int = 9) -> None:
    """quads (id, p: array of four structs x, y, z) as one OBJ text, in the order of id; an export of one building."""
    n = F.row_number().over(Window.orderBy("id"))
    lines = quads.withColumn("n", n).select("n", F.concat(F.transform("p", lambda q: vertex_line(q["x"], q["y"], q["z"], digits)), F.array(face_line((F.col("n") - 1) * 4 + 1))).alias("lines"))
    body = lines.select("n", F.posexplode("lines").alias("i", "value"))
    head = quads.sparkSession.createDataFrame([(0, 0, "# world origin: {} {} {}".format(*origin))], "n int, i int, value string")
    head.unionByName(body).orderBy("n", "i").coalesce(1).select("value").write.mode("overwrite").text(path)
