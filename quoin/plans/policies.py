"""More queries of the engine with their DuckDB equivalents: policies, states, cameras and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import detection as D
from quoin.operators import matching as M
from quoin.operators import policy as L
from quoin.operators import raster as R
from quoin.operators import state as S

from . import views as W
from .catalogue import ORACLES, QUERIES, query, rounded

__all__ = ["ORACLES", "QUERIES"]


def _when(cases: list[tuple[str, str]], last: str | None = None):
    """A CASE over (condition, value) in SQL that both engines read."""
    end = "NULL" if last is None else f"'{last}'"
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in cases) + f" ELSE {end} END"


@query(f"WITH {W.MATCH_SQL} SELECT cand, ord, object_index FROM m WHERE confidence >= 0.2 AND rx >= -0.5 AND ry >= -0.5 AND rx < 899.5 AND ry < 499.5 AND object_index IN (1, 2, 4)")
def usable_matches(spark, sf):
    allowed = W.objects(spark).where("object_index IN (1, 2, 4)").select("object_index")
    return M.usable(W.matches(spark, sf), allowed, F.lit(900), F.lit(500)).select("cand", "ord", "object_index")


@query("SELECT c_custkey, round((c_custkey % 101) / 100.0 * least(1.0, (c_custkey % 67) / 66.0 / 0.6), 6) AS score FROM customer")
def geometry_scores(spark, sf):
    k = F.col("c_custkey")
    c = W.table(spark, sf, "customer")
    return rounded(c.select("c_custkey", M.geometry_score(k % 101 / 100.0, k % 67 / 66.0).alias("score")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN 'structure' ELSE 'base' END AS method, CAST(CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN 2 ELSE 1 END * s_suppkey AS DOUBLE) AS h0 FROM supplier")
def chosen_transforms(spark, sf):
    k = F.col("s_suppkey")
    s = W.table(spark, sf, "supplier").select("s_suppkey", F.array(k * 1.0, F.lit(0.0)).alias("base_h"), F.array(k * 2.0, F.lit(0.0)).alias("structure_h"), F.when(k % 5 != 0, k % 3 == 0).alias("structure_passed"))
    return L.choose_transform(s).select("s_suppkey", "method", F.get("h", F.lit(0)).cast("double").alias("h0"))


REGIONS = [("p_partkey % 11 = 0", "fewer_than_three_points"), ("p_partkey % 7 = 0", "outside_image"), ("p_partkey % 5 = 0", "repeated_vertex"), ("p_partkey % 13 = 0", "too_small"), ("p_partkey % 3 = 0", "edges_cross")]


@query(f"SELECT p_partkey, {_when(REGIONS)} AS problem FROM part")
def region_check(spark, sf):
    """Quadrangles that break one rule or none: two points; a corner outside; a corner twice; tiny; two corners swapped."""
    k = F.col("p_partkey")
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    w = (k % 40 + 10).cast("double")
    square = [point(5.0, 5.0), point(w, 5.0), point(w, 60.0), point(5.0, 60.0), point(5.0, 5.0)]
    p = (
        F.when(k % 11 == 0, F.array(*square[:2])).when(k % 7 == 0, F.array(*square[:2], point(101.0, 60.0), square[3]))
        .when(k % 5 == 0, F.array(square[0], square[1], square[2], square[1], square[3])).when(k % 13 == 0, F.array(point(1.0, 1.0), point(1.5, 1.0), point(1.5, 1.5)))
        .when(k % 3 == 0, F.array(square[0], square[2], square[1], point(5.0, 30.0))).otherwise(F.array(*square))
    )
    return W.table(spark, sf, "part").select("p_partkey", L.region_problem(p, 100.0, 80.0).alias("problem"))


EYE = (3.0, -4.0, 0.0)
CAM_SQL = """p AS (SELECT c_nationkey AS n, c_custkey % 97 * 1.0 AS x, c_custkey % 61 * 1.0 AS y, c_custkey % 31 * 1.0 AS z FROM customer),
a AS (SELECT n, min(0.8 * x + 0.6 * y) AS s0, max(0.8 * x + 0.6 * y) AS s1, min(z) AS t0, max(z) AS t1, 2 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS far FROM p GROUP BY n),
k AS (SELECT *, least(799 * 0.9 / (s1 - s0), 599 * 0.9 / (t1 - t0)) AS k FROM a)"""


@query(f"""WITH {CAM_SQL} SELECT n, round(k, 6) AS pixels_per_meter, round(799 / 2.0 + k * (0.8 * 7 + 0.6 * 11 - (s0 + s1) / 2), 6) AS px, round(599 / 2.0 - k * (13 - (t0 + t1) / 2), 6) AS py,
round(far - 0.6 * 7 + 0.8 * 11, 6) AS depth, CAST(7 AS DOUBLE) AS x, CAST(11 AS DOUBLE) AS y, CAST(13 AS DOUBLE) AS z FROM k""")
def orthographic_camera(spark, sf):
    """A camera for each nation's points, the pixel and depth of one point in it, and the way back."""
    k = F.col("c_custkey")
    p = W.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), (k % 97 * 1.0).cast("double").alias("x"), (k % 61 * 1.0).cast("double").alias("y"), (k % 31 * 1.0).cast("double").alias("z"))
    c = L.cameras(p, "n", EYE, (800, 600), 0.05)
    on = lambda m, r, v: sum((F.get(m, F.lit(4 * r + i)) * x for i, x in enumerate(v)), F.lit(0.0)) + F.get(m, F.lit(4 * r + 3))
    here = (F.lit(7.0), F.lit(11.0), F.lit(13.0))
    c = c.withColumns({n: on("local_to_pixel", i, here) for i, n in enumerate(("px", "py", "depth"))})
    back = {n: on("pixel_to_local", i, (F.col("px"), F.col("py"), F.col("depth"))) for i, n in enumerate("xyz")}
    return rounded(c.withColumns(back).select("n", "pixels_per_meter", "px", "py", "depth", "x", "y", "z"))


@query("SELECT CAST(orbit AS DOUBLE) AS orbit, CAST(elevation AS DOUBLE) AS elevation FROM (VALUES (0.0, 0.0), (90.0, 0.0), (180.0, 0.0), (270.0, 0.0), (45.0, 22.0), (135.0, 22.0), (225.0, 22.0), (315.0, 22.0)) t(orbit, elevation)")
def view_directions(spark, sf):
    return spark.createDataFrame(R.view_directions(), "orbit double, elevation double")


@query("""WITH n AS (SELECT c_custkey, 0.6 * (c_custkey % 3 - 1) + 0.8 * (c_custkey % 2) AS v, (c_custkey % 2) * 1.0 AS l FROM customer)
SELECT c_custkey, v < 0 AS front, round(CAST(0.6 + 0.25 * abs(v) + 0.15 * abs(l) AS DOUBLE), 6) AS brightness FROM n""")
def surface_shade(spark, sf):
    k = F.col("c_custkey")
    front, light = R.shade((k % 3 - 1).cast("double"), F.lit(0.0), (k % 2).cast("double"), (0.6, 0.0, 0.8), (0.0, 0.0, 1.0))
    return rounded(W.table(spark, sf, "customer").select("c_custkey", front.alias("front"), light.alias("brightness")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")
def reusable_renders(spark, sf):
    k = F.col("o_orderkey")
    view = F.struct(F.lit(1800).alias("w"), F.lit(1200).alias("h"), (k % 11 == 0).alias("missing"))
    o = W.table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, "complete").otherwise("failed").alias("status"), F.when(k % 3 == 0, "old").otherwise("now").alias("source_sha256"), F.lit("s").alias("script_sha256"), (k % 5 == 0).alias("front_manual"), F.lit(1800).alias("w"), F.lit(1200).alias("h"), F.array_repeat(view, F.when(k % 7 == 0, 7).otherwise(8)).alias("views"))
    return L.reusable(o, F.lit("now"), F.lit("s"), (1800, 1200)).select("o_orderkey")


@query("WITH c AS (SELECT c_custkey, ((c_custkey % 10) / 10.0 + (c_custkey % 7) / 7.0 + (c_custkey % 3) / 3.0) / 3 AS c FROM customer) SELECT c_custkey, round(c, 6) AS confidence, c < 0.5 AS review FROM c")
def confidence_review(spark, sf):
    k = F.col("c_custkey")
    c, review = L.confidence(k % 10 / 10.0, k % 7 / 7.0, k % 3 / 3.0)
    return rounded(W.table(spark, sf, "customer").select("c_custkey", c.alias("confidence"), review.alias("review")))


@query("""SELECT p_partkey, edge, CAST(CASE WHEN edge IN (0, 2) THEN 4.0 ELSE 3.0 END AS DOUBLE) AS length, CAST(p_size + 2.0 AS DOUBLE) AS height, CAST(CASE WHEN edge IN (0, 2) THEN 4.0 ELSE 3.0 END * (p_size + 2.0) AS DOUBLE) AS face_area
FROM part, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS edge)""")
def footprint_faces(spark, sf):
    """A box of 4 by 3 metres for each part."""
    at = lambda z: F.array(*[F.array(F.lit(x), F.lit(y), z) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))])
    p = W.table(spark, sf, "part")
    rings = p.select("p_partkey", F.lit("GroundSurface").alias("kind"), at(F.lit(-1.0)).alias("points")).union(p.select("p_partkey", F.lit("RoofSurface"), at(F.col("p_size") + F.lit(1.0))))
    return L.footprints(rings, "p_partkey").select("p_partkey", "edge", "length", "height", "face_area")


@query("""SELECT p_partkey, sha256('{"model":"' || p_brand || '","size":' || p_size || '}') AS key FROM part""")
def cache_identity(spark, sf):
    return W.table(spark, sf, "part").select("p_partkey", S.identity(size=F.col("p_size"), model=F.col("p_brand")).alias("key"))


@query(f"WITH {W.DET_SQL} SELECT img, ord, printf('P%04d', ord) AS prediction_id FROM det")
def prediction_numbers(spark, sf):
    return L.prediction_ids(W.detections(spark, sf), "img", "ord").select("img", "ord", "prediction_id")


@query("SELECT c_nationkey AS building, c_mktsegment AS wall_id, round(sum(c_acctbal), 4) AS area_m2, count(*) AS polygons, round(max(c_acctbal), 4) AS largest FROM customer GROUP BY ALL")
def wall_polygons(spark, sf):
    c = W.table(spark, sf, "customer").select(F.col("c_nationkey").alias("building"), F.col("c_mktsegment").alias("wall_id"), F.col("c_acctbal").cast("double").alias("area"), *[F.lit(x).alias(n) for n, x in (("nx", 1.0), ("ny", 0.0), ("nz", 0.0))])
    return rounded(L.wall_metadata(c, "building").select("building", "wall_id", "area_m2", F.size("polygons").cast("long").alias("polygons"), F.get("polygons", F.lit(0))["area"].alias("largest")), 4)


@query("""WITH t AS (SELECT o_custkey AS photo, o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'skipped' ELSE 'completed' END AS status FROM orders),
k AS (SELECT l_orderkey AS name, count(*) AS n FROM lineitem WHERE l_orderkey % 4 = 2 GROUP BY 1),
r AS (SELECT photo, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(coalesce(sum(n), 0) AS BIGINT) AS kept FROM t LEFT JOIN k USING (name) GROUP BY photo)
SELECT *, CASE WHEN kept = 0 THEN 'no_matches' WHEN failed = 0 AND skipped = 0 THEN 'complete' ELSE 'partial' END AS status FROM r""")
def tile_outcomes(spark, sf):
    k = F.col("o_orderkey")
    o = W.table(spark, sf, "orders").select(F.col("o_custkey").alias("photo"), k.alias("name"), F.when(k % 4 == 0, "failed").when(k % 4 == 1, "skipped").otherwise("completed").alias("status"))
    kept = W.table(spark, sf, "lineitem").where("l_orderkey % 4 = 2").join(o, F.col("l_orderkey") == F.col("name")).select("photo", "name")
    return L.tile_report(o, kept, "photo")


@query("""WITH t AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'pending' END AS state FROM orders),
r AS (SELECT run, count(*) AS n, count(*) FILTER (state = 'success') AS n_done, count(*) FILTER (state = 'failed') AS n_failed FROM t GROUP BY run)
SELECT *, CASE WHEN n_done + n_failed < n THEN 'running' WHEN n_failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM r""")
def batch_outcomes(spark, sf):
    s = F.col("o_orderstatus")
    return S.batch_outcome(W.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.when(s == "F", "success").when(s == "O", "failed").otherwise("pending").alias("state")), "run")


OUTCOMES = [("o_orderkey % 7 = 0", "failed"), ("o_orderkey % 5 = 0", "running"), ("o_orderkey % 3 = 0 OR o_orderkey % 11 = 0", "needs_review"), ("o_orderkey % 4 > 0", "mapped")]


@query(f"SELECT o_orderkey, {_when(OUTCOMES, 'no_detections_mapped')} AS status FROM orders")
def mapping_outcomes(spark, sf):
    k = F.col("o_orderkey")
    o = W.table(spark, sf, "orders").select("o_orderkey", F.when(k % 7 == 0, "e").alias("error"), (k % 5 != 0).alias("finished"), F.when(k % 3 != 0, k).alias("selected_id"), F.when(k % 11 == 0, "refused").alias("mapping_error"), (k % 4).alias("mapped_count"))
    return S.mapping_status(o).select("o_orderkey", "status")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS seq, ['loading_model', 'rendering_views', 'contact_sheet', 'complete', 'failed'][1 + least(l_linenumber - 1 + (l_orderkey % 2), 4)] AS stage FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT k, max_by(stage, seq) FILTER (stage <> 'failed') AS stage, CASE max_by(stage, seq) WHEN 'failed' THEN 'failed' WHEN 'complete' THEN 'complete' ELSE 'running' END AS status FROM l GROUP BY k""")
def render_states(spark, sf):
    lines = W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    step = F.least(F.col("l_linenumber") - 1 + F.col("l_orderkey") % 2, F.lit(4)).cast("int")
    names = F.array(*[F.lit(x) for x in (*S.RENDER_STAGES, "failed")])
    return S.render_state(lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), F.get(names, step).alias("stage")), "k")


@query("SELECT p_brand AS grp, p_partkey AS building_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def task_queue(spark, sf):
    p = W.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("building_id"), F.col("p_size").alias("size_bytes"))
    return L.task_order(p, "grp").select("grp", "building_id", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 'source_model_changed' END AS reject_reason FROM part")
def source_changes(spark, sf):
    k = F.col("p_partkey")
    p = W.table(spark, sf, "part")
    made = p.select("p_partkey", k.cast("string").alias("source_gml"), F.concat(F.lit("a"), k).alias("source_sha256"))
    now = p.where(k % 3 != 0).select(k.cast("string").alias("source_gml"), F.concat(F.when(k % 4 == 0, "b").otherwise("a"), k).alias("source_sha256"))
    return L.unchanged_source(made, now).select("p_partkey", "reject_reason")


@query("SELECT p_partkey, p_partkey % 6 = 0 AS usable_name, p_size > 3 AS usable_size FROM part")
def folder_and_size(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    names = F.array(*[F.lit(x) for x in ("4959323", "", "..", "a/b", "end.", "what?")])
    return W.table(spark, sf, "part").select("p_partkey", L.folder_name(F.get(names, (k % 6).cast("int"))).alias("usable_name"), L.image_size(n - 2, F.lit(2.0)).alias("usable_size"))


@query("""WITH p AS (SELECT l_orderkey % 40 AS v, l_linenumber AS x, CAST(l_orderkey // 40 AS BIGINT) AS y, count(*) AS n, bool_or(l_orderkey % 280 = 0 AND l_linenumber = 2) AS odd, bool_or(l_orderkey % 440 = 1 AND l_linenumber = 1) AS behind FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT v AS view_id, count(*) FILTER (x >= 7) AS outside, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (odd) AS unmatched, count(*) FILTER (behind) AS not_positive FROM p GROUP BY v)
SELECT *, CASE WHEN outside > 0 THEN 'pixel_outside_image' WHEN repeated > 0 THEN 'pixel_repeated' WHEN unmatched > 0 THEN 'depth_without_object_or_reverse' WHEN not_positive > 0 THEN 'depth_not_positive' END AS reject_reason FROM r""")
def raster_integrity(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    p = W.table(spark, sf, "lineitem").select((k % 40).alias("view_id"), n.alias("x"), F.expr("l_orderkey div 40").alias("y"), F.when((k % 280 == 0) & (n == 2), -1).otherwise(3).alias("object_index"), F.when((k % 440 == 1) & (n == 1), -2.0).otherwise(5.0).alias("depth"), F.lit(7).alias("w"), F.lit(10**9).alias("h"))
    return R.integrity(p)


@query("""WITH d AS (SELECT p_partkey, 'b' || (p_partkey % 3) AS batch FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND p_partkey % 7 <> 0 THEN 'f' || p_partkey END AS path, CASE WHEN NOT (p_partkey % 3 = 2 AND p_partkey % 7 <> 0) THEN 'no_detection_of_this_image' END AS reject_reason FROM d""")
def detection_lookup(spark, sf):
    k = F.col("p_partkey")
    p = W.table(spark, sf, "part").select("p_partkey", F.sha2(k.cast("string"), 256).alias("sha256"), F.lit(800).alias("w"), F.lit(600).alias("h"), F.lit("full").alias("coordinate_system"))
    d = p.select("sha256", F.when(k % 7 == 0, 801).otherwise(800).alias("w"), "h", "coordinate_system", F.concat(F.lit("f"), k).alias("path"), F.concat(F.lit("b"), k % 3).alias("batch_id"))
    b = spark.createDataFrame([("b0", 1), ("b2", 3), ("b1", 2)], "batch_id string, seq int")
    return D.lookup(p, b, d).select("p_partkey", "path", "reject_reason")


@query(f"""WITH {W.DET_SQL} SELECT img, count(*) FILTER (kind = 'window' AND ord % 4 <> 0) AS n_window, count(*) FILTER (kind = 'door' AND ord % 4 <> 0) AS n_door, CAST(0 AS BIGINT) AS n_ambiguous, count(*) FILTER (ord % 4 <> 0) AS mapped, count(*) FILTER (ord % 4 = 0) AS rejected FROM det GROUP BY img""")
def mapped_class_counts(spark, sf):
    d = W.detections(spark, sf).withColumns({"class": F.col("kind"), "reject_reason": F.when(F.col("ord") % 4 == 0, "r")})
    return D.mapped_counts(d, "img")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def progress_index(spark, sf):
    return S.progress(W.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT s_suppkey AS building_id, 'view' || v AS view_name, 'w' || w AS wall_id FROM supplier, (SELECT unnest([0, 1, 2]) AS v), (SELECT unnest([1, 2]) AS w) WHERE s_suppkey % 4 <> 0 AND w <= s_suppkey % 3")
def gallery_flat(spark, sf):
    k = F.col("s_suppkey")
    walls = F.filter(F.array(F.lit("w1"), F.lit("w2")), lambda w: F.substring(w, 2, 1).cast("int") <= k % 3)
    views = F.array(*[F.struct(F.lit(f"view{v}").alias("view_name"), walls.alias("walls")) for v in range(3)])
    return S.gallery_rows(W.table(spark, sf, "supplier").select(k.alias("building_id"), F.when(k % 4 == 0, "failed").otherwise("complete").alias("status"), views.alias("views")))


@query("SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS building_id, c_custkey AS expected_id, o_orderkey % 5 > 0 AS correct FROM orders JOIN customer ON o_custkey = c_custkey")
def evaluation_join(spark, sf):
    o = W.table(spark, sf, "orders")
    truth = o.join(W.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("photo_id"), F.col("c_custkey").alias("building_id"))
    return S.evaluated(o.select(F.col("o_orderkey").alias("photo_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("building_id")), truth)


WALLS = [("p_partkey % 5 = 0", "wall_not_found"), ("p_partkey % 7 = 0", "wall_id_not_unique"), ("p_partkey % 3 = 0", "source_model_changed"), ("p_partkey % 4 = 0", "wall_not_planar"), ("p_partkey % 11 = 0", "invalid_boundary")]


@query(f"SELECT p_partkey AS building_id, {_when(WALLS)} AS reject_reason FROM part")
def wall_validation(spark, sf):
    k = F.col("p_partkey")
    p = W.table(spark, sf, "part")
    one = p.where(k % 5 != 0).select(k.alias("building_id"), F.lit("w").alias("wall_id"), F.when(k % 3 == 0, "old").otherwise("now").alias("source_sha256"), F.array_repeat(F.lit(0.0), F.when(k % 11 == 0, 2).otherwise(4)).alias("points"), (k % 4 != 0).alias("planar"))
    wanted = p.select(k.alias("building_id"), F.lit("w").alias("wall_id"), F.lit("now").alias("source_sha256"))
    return L.validated_wall(wanted, one.union(one.where(F.col("building_id") % 7 == 0))).select("building_id", "reject_reason")


@query("""WITH t AS (SELECT l_orderkey AS img, l_linenumber AS n, l_quantity FROM lineitem) SELECT img, count(*) AS n_raw, count(*) FILTER (n % 3 = 0) AS n_rejected, CASE WHEN count(*) FILTER (n % 3 <> 0) > 0 THEN count(DISTINCT n) FILTER (n % 3 <> 0) ELSE 0 END AS n_groups FROM t GROUP BY img""")
def tile_merge(spark, sf):
    """Boxes far apart by line number, those of every third number of a category that is not expected; equal ones merge."""
    n = F.col("l_linenumber")
    x = (n * 100).cast("double")
    raw = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("img"), F.when(n % 3 == 0, "tree").otherwise(" Window. ").alias("category"), F.lit(0.5).alias("score"), x.alias("x0"), F.lit(20.0).alias("y0"), (x + 40).alias("x1"), F.lit(80.0).alias("y1"), *[F.lit(v).alias(c) for c, v in (("tx0", 0.0), ("ty0", 0.0), ("tx1", 1200.0), ("ty1", 1000.0), ("w", 1200.0), ("h", 1000.0))])
    return D.merge_tiles(raw)[1]


@query(f"WITH {W.MATCH_SQL}, r AS (SELECT *, abs(rx - px) AS e, cand * 10000000 + ord AS uid, floor(px / 100) AS c, floor(py / 100) AS d FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY cand, c, d ORDER BY e, uid) AS k FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY e, uid) AS p FROM b WHERE k = 1) SELECT uid, round(e, 6) AS e FROM t WHERE p <= 20")
def thinned_matches(spark, sf):
    """Of each candidate's picture the twenty best, one of a cell."""
    m = W.matches(spark, sf).withColumns({"e": F.abs(F.col("rx") - F.col("px")), "uid": F.col("cand") * 10_000_000 + F.col("ord"), "c": F.floor(F.col("px") / 100), "d": F.floor(F.col("py") / 100)})
    return M.thin(m, "e", ["cand", "c", "d"], 20, "uid", ["cand"]).select("uid", F.round(F.col("e").cast("double"), 6).alias("e"))


@query("SELECT p_partkey, CAST(2 * p_size - 1 AS DOUBLE) AS u, CAST(p_size AS DOUBLE) AS v, CAST(2 * p_size AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part")
def wall_coordinates(spark, sf):
    """A point on a wall in the wall's coordinates, and back."""
    frame = {"origin": (1.0, 0.0, 0.0), "u": (1.0, 0.0, 0.0), "v": (0.0, 0.0, 1.0)}
    p = W.table(spark, sf, "part").select("p_partkey", L.to_uv(F.col("p_size") * F.lit(2.0), F.lit(0.0), F.col("p_size") * F.lit(1.0), frame).alias("w"))
    return rounded(p.select("p_partkey", "w.*", L.to_xyz(F.col("w.u"), F.col("w.v"), frame).alias("q")).select("p_partkey", "u", "v", "q.*"))
