"""Files in, tables out, and job states as a stream."""

from datetime import datetime

from pyspark.sql import functions as F

from quoin.sources import citygml, files, obj
from quoin.streaming import jobs

RING = "0 0 0 10 0 0 10 0 10 0 0 10 0 0 0"
HOLE = "2 0 2 4 0 2 4 0 4 2 0 4 2 0 2"
GML = f"""<c:CityModel xmlns:c="http://www.opengis.net/citygml/2.0" xmlns:b="http://www.opengis.net/citygml/building/2.0" xmlns:g="http://www.opengis.net/gml" xmlns:a="http://www.opengis.net/citygml/appearance/2.0">
<c:cityObjectMember><b:Building g:id="B"><b:boundedBy><b:WallSurface g:id="W"><b:lod3MultiSurface><g:MultiSurface><g:surfaceMember><g:Polygon g:id="P">
<g:exterior><g:LinearRing><g:posList>{RING}</g:posList></g:LinearRing></g:exterior><g:interior><g:LinearRing><g:posList>{HOLE}</g:posList></g:LinearRing></g:interior></g:Polygon></g:surfaceMember></g:MultiSurface></b:lod3MultiSurface>
<b:opening><b:Window g:id="O"><b:lod3MultiSurface><g:Polygon><g:exterior><g:LinearRing><g:posList>{HOLE}</g:posList></g:LinearRing></g:exterior></g:Polygon></b:lod3MultiSurface></b:Window></b:opening></b:WallSurface></b:boundedBy></b:Building></c:cityObjectMember>
<a:X3DMaterial><a:diffuseColor>1 0 0.5</a:diffuseColor><a:target>#P</a:target></a:X3DMaterial><a:imageURI>t.png</a:imageURI></c:CityModel>"""


def test_citygml(spark, tmp_path):
    (tmp_path / "model_1.gml").write_text(GML)
    (tmp_path / "model_2.gml").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 5\n")
    rings = citygml.read_rings(spark, str(tmp_path))
    assert rings.where("error LIKE '%pointer%'").count() == 1
    assert sorted(tuple(r) for r in citygml.objects(rings).select("object_index", "id", "kind", "wall_id").collect()) == [(0, "W", "WallSurface", "W"), (1, "O", "Window", "W")]
    wall = citygml.read_walls(rings).first()
    assert (wall.width, wall.height, wall.n_references) == (10.0, 10.0, 1)
    t = citygml.triangles(rings)
    side = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    u, v = side("b", "a"), side("c", "a")
    area = F.abs(u[0] * v[2] - u[2] * v[0]) / 2
    assert {r.object_index: round(r.s, 6) for r in t.groupBy("object_index").agg(F.sum(area).alias("s")).collect()} == {0: 96.0, 1: 4.0}
    s = citygml.stats(rings).first()
    assert (s.n_WallSurface, s.n_Window, s.polygons, s.interior_rings) == (1, 1, 2, 1)
    only = str(tmp_path / "model_1.gml")
    assert tuple(citygml.materials(spark, only).first())[1:3] == ("P", True)
    none = spark.createDataFrame([], "image string")
    assert [r.image for r in citygml.missing_textures(spark, only, none).collect()] == ["t.png"]
    assert {r.building_id: r.found for r in citygml.models(spark, str(tmp_path), "model_", wanted=["1", "9"]).collect()} == {"1": True, "9": False}


def test_obj_round_trip(spark, tmp_path):
    quads = spark.createDataFrame([(1, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 1.0), (0.0, 0.0, 1.0)]), (2, [(5.0, 0.0, 0.0), (6.0, 0.0, 0.0), (6.0, 0.0, 1.0), (5.0, 0.0, 1.0)])], "id int, p array<struct<x:double,y:double,z:double>>")
    obj.write_quads(quads, str(tmp_path / "out"), (1.0, 2.0, 3.0))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.obj").write_text(text + "f -4 -3 -2 -1\n")
    got = obj.read_faces(spark, str(tmp_path / "in")).orderBy("face", "corner").collect()
    assert len(got) == 12 and [r.x for r in got] == [0, 1, 1, 0, 5, 6, 6, 5, 5, 6, 6, 5]


def test_images_and_latest_runs(spark, tmp_path):
    for name in ("B.JPG", "a.png", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = files.images(spark, str(tmp_path)).collect()
    assert [(r.stem, r.duplicate) for r in got] == [("a", False), ("b", True), ("b", True)]
    runs = spark.createDataFrame([("b", "r1", 1, "complete"), ("b", "r2", 2, "failed")], "building string, run_dir string, started_at int, status string")
    assert files.latest(runs, "building").first().run_dir == "r2" and files.latest(runs, "building", complete_only=True).first().run_dir == "r1"
    files.write_csv(spark.createDataFrame([(1, float("nan"), 2)], "a int, e double, x int"), str(tmp_path / "csv"), ["a", "e"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().e is None


def test_job_states_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("r", "t1", 1, "pending", None, at), ("r", "t1", 2, "completed", "k", at), ("r", "t2", 1, "submitting", None, at), ("r", "t3", 1, "waiting", "q", at), ("r", "t4", 1, "pending", None, at)]
    df = spark.createDataFrame(rows, "run string, tile string, seq int, state string, task string, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.to_table(jobs.current(stream, ["run", "tile"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    assert {r.tile: r.action for r in jobs.resumable(states).collect()} == {"t1": "keep", "t2": "review", "t3": "poll", "t4": "post"}
    assert jobs.run_status(states, "run").first().status == "running"
