"""CityGML 2.0 buildings as rows of rings, walls and triangles.

A file is one XML tree, so one task parses one file; files spread over tasks. Tags are matched by namespace, never by
prefix. Files that are only pointers to large-file storage are refused."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import kernels as K
from quoin.operators.planes import plane_frame

# Namespaces of CityGML 2.0, the kinds of surfaces, and the first line of a pointer file.
GML = "{http://www.opengis.net/gml}"
BUILDING = "{http://www.opengis.net/citygml/building/2.0}"
APPEARANCE = "{http://www.opengis.net/citygml/appearance/2.0}"
KINDS = ("WallSurface", "RoofSurface", "GroundSurface", "Window", "Door")
POINTER = b"version https://git-lfs"

RINGS = "path string, object_index int, object_id string, kind string, wall_id string, polygon int, polygon_id string, ring int, points array<array<double>>, error string"
TRIANGLES = "path string, object_index int, polygon int, tri int, a array<double>, b array<double>, c array<double>, normal array<double>, error string"
MATERIALS = "path string, target string, front boolean, r double, g double, b double"
TEXTURES = "path string, image string"


def refuse_pointer(data: bytes) -> None:
    if data[: len(POINTER)] == POINTER:
        raise ValueError("the file is a pointer to large-file storage, not a model")


def numbers(text: str | None) -> np.ndarray | None:
    """A posList as n x 3; null unless it has nine numbers or more, in threes."""
    v = np.array((text or "").split(), dtype=float)
    return v.reshape(-1, 3) if len(v) >= 9 and len(v) % 3 == 0 else None


def surfaces(root: ET.Element) -> Iterator[tuple[int, str, str, str | None, ET.Element]]:
    """(index, id, kind, wall, geometry) of each object that owns a surface of its own, the finer level first; openings
    belong to the wall they are in."""
    index = 0
    todo: list[tuple[ET.Element, str | None]] = [(root, None)]
    while todo:
        node, wall = todo.pop()
        kind, name = node.tag.rsplit("}", 1)[-1], node.get(f"{GML}id")
        wall = name if kind == "WallSurface" else wall
        if kind in KINDS:
            own = next((g for g in (node.find(f"{BUILDING}lod{n}MultiSurface") for n in (3, 2)) if g is not None), None)
            if own is not None and own.find(f".//{GML}Polygon") is not None:
                yield index, name, kind, wall, own
                index += 1
        todo += [(c, wall) for c in reversed(list(node)) if not c.tag.endswith(("lod2MultiSurface", "lod3MultiSurface", "lod2Solid", "lod3Solid"))]


def _parsed(spark: SparkSession, path: str, glob: str, parse, schema: str) -> DataFrame:
    """parse(root) -> rows; what cannot be read becomes one row with `error` where the schema has one."""
    names = [f.split()[0] for f in schema.replace(", ", ",").split(",")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    refuse_pointer(bytes(data))
                    rows = [dict(r, path=p) for r in parse(ET.fromstring(bytes(data)))]
                except (ValueError, ET.ParseError) as e:
                    if "error" not in names:
                        raise
                    rows = [{"path": p, "error": str(e)}]
                yield pd.DataFrame(rows).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.mapInPandas(run, schema)


def read_rings(spark: SparkSession, path: str, glob: str = "*.gml") -> DataFrame:
    """All rings (0: exterior) of all polygons of all objects under path, in world coordinates."""

    def parse(root: ET.Element) -> Iterator[dict]:
        for index, name, kind, wall, own in surfaces(root):
            for n, polygon in enumerate(own.iter(f"{GML}Polygon")):
                outer = polygon.find(f"{GML}exterior/{GML}LinearRing/{GML}posList")
                if outer is None:
                    raise ValueError("a polygon's exterior is not a posList")
                for r, pos in enumerate([outer, *polygon.findall(f"{GML}interior/{GML}LinearRing/{GML}posList")]):
                    points = numbers(pos.text)
                    if points is not None:
                        yield {"object_index": index, "object_id": name, "kind": kind, "wall_id": wall, "polygon": n, "polygon_id": polygon.get(f"{GML}id"), "ring": r, "points": points.tolist()}

    return _parsed(spark, path, glob, parse, RINGS)


def objects(rings: DataFrame) -> DataFrame:
    return rings.where("error IS NULL").select("path", "object_index", F.col("object_id").alias("id"), "kind", "wall_id").distinct()


def stats(rings: DataFrame) -> DataFrame:
    """Counts for each building file."""
    per = rings.where("error IS NULL").groupBy("path").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("object_index"))).alias(f"n_{k}") for k in KINDS], F.count_if(F.col("ring") == 0).alias("polygons"), F.count_if(F.col("ring") > 0).alias("interior_rings"))
    return per


def read_walls(rings: DataFrame) -> DataFrame:
    """Planar walls with frame, size and area_rank, largest first in each building; others are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        outer = [np.array([list(x) for x in p], float) for p in pdf.loc[pdf["ring"] == 0, "points"]]
        base = {"path": pdf["path"].iloc[0], "wall_id": pdf["wall_id"].iloc[0]}
        try:
            f = plane_frame(np.vstack(outer))
        except ValueError:
            return pd.DataFrame([])
        uv = (np.vstack(outer) - f["origin"]) @ np.column_stack([f["u"], f["v"]])
        span = np.ptp(uv, axis=0)
        return pd.DataFrame([base | f | {"width": float(span[0]), "height": float(span[1]), "area_rank": float(np.prod(span)), "n_references": int((pdf["ring"] > 0).sum())}])

    schema = "path string, wall_id string, origin array<double>, u array<double>, v array<double>, deviation double, width double, height double, area_rank double, n_references int"
    own = rings.where("error IS NULL AND kind = 'WallSurface'").select("path", "wall_id", "ring", "points")
    return own.groupBy("path", "wall_id").applyInPandas(run, schema)


def triangles(rings: DataFrame) -> DataFrame:
    """Triangles of each polygon, by its plane; degenerate polygons give none, unsupported ones a row with error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {k: pdf[k].iloc[0] for k in ("path", "object_index", "polygon")}
        pts = [K.clean_ring(np.array([list(x) for x in p], float)) for p in pdf.sort_values("ring")["points"]]
        try:
            o = pts[0].mean(axis=0)
            _, s, vt = np.linalg.svd(pts[0] - o, full_matrices=False)
            if len(pts[0]) < 3 or s[1] < 1e-9:
                return pd.DataFrame([])
            if np.abs((pts[0] - o) @ vt[2]).max() > 0.01:
                raise ValueError("polygon is more than 1 cm off its plane")
            flat = [(p - o) @ vt[:2].T for p in pts]
            n = np.cross(vt[0], vt[1]) * (1 if K.area(flat[0]) > 0 else -1)
            t = K.triangulate(flat[0], flat[1:]) @ vt[:2] + o
            return pd.DataFrame([key | {"tri": i, "a": x[0].tolist(), "b": x[1].tolist(), "c": x[2].tolist(), "normal": n.tolist(), "error": None} for i, x in enumerate(t)])
        except ValueError as e:
            return pd.DataFrame([key | {"tri": None, "a": None, "b": None, "c": None, "normal": None, "error": str(e)}])

    return rings.where("error IS NULL").select("path", "object_index", "polygon", "ring", "points").groupBy("path", "object_index", "polygon").applyInPandas(run, TRIANGLES)


def materials(spark: SparkSession, path: str, glob: str = "*.gml") -> DataFrame:
    """Diffuse colours (0-255) by target polygon and side."""

    def parse(root: ET.Element) -> Iterator[dict]:
        for m in root.iter(f"{APPEARANCE}X3DMaterial"):
            colour = m.findtext(f"{APPEARANCE}diffuseColor")
            if colour:
                r, g, b = (float(x) * 255 for x in colour.split())
                front = (m.findtext(f"{APPEARANCE}isFront") or "true").strip() == "true"
                for t in m.findall(f"{APPEARANCE}target"):
                    yield {"target": (t.text or "").strip().lstrip("#"), "front": front, "r": r, "g": g, "b": b}

    return _parsed(spark, path, glob, parse, MATERIALS)


def missing_textures(spark: SparkSession, path: str, listing: DataFrame, glob: str = "*.gml") -> DataFrame:
    """Texture images that models name and the listing (image) lacks."""

    def parse(root: ET.Element) -> Iterator[dict]:
        for i in root.iter(f"{APPEARANCE}imageURI"):
            yield {"image": (i.text or "").strip()}

    return _parsed(spark, path, glob, parse, TEXTURES).distinct().join(listing, "image", "left_anti")


def models(spark: SparkSession, path: str, prefix: str = "", wanted: list[str] | None = None) -> DataFrame:
    """(building_id, path, size, sha256, found) of model files; wanted ids without a file have found = false."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.gml").load(path)
    have = files.select(F.regexp_extract("path", rf"{prefix}(.+)\.gml$", 1).alias("building_id"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if wanted is None:
        return have.withColumn("found", F.lit(True))
    ask = spark.createDataFrame([(w,) for w in wanted], "building_id string")
    return ask.join(have, "building_id", "left").withColumn("found", F.col("path").isNotNull())
