"""Correspondences: filters, hold-out, errors, gates, votes, selection and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import numeric as N

from . import kernels as K
from . import raster as R

#: Fixed values of the policies.
MIN_CONFIDENCE = 0.20
VOTE = (8, 0.60, 0.50)
MIN_SCORE, MIN_MARGIN, HULL_FULL = 0.35, 0.08, 0.60
AGREEMENT = (6, 0.30, 0.75)
AGREEMENT_GRID = (9, 5, 0.1, 0.9)
MATCH_SIZE, MATCH_DISTANCE = (0.55, 1.80), 30.0
WALL_PIXELS, WALL_SHARE, WALL_SIDE = 500, 0.30, 32


def usable(matches: DataFrame, allowed: DataFrame, width: Column, height: Column) -> DataFrame:
    """Matches with enough confidence whose render point is in the image and on an allowed object (semi-join)."""
    ok = N.finite(F.col("px"), F.col("py")) & (F.col("confidence") >= MIN_CONFIDENCE) & N.inside(F.col("rx"), F.col("ry"), width, height)
    return matches.where(ok).join(allowed, "object_index", "left_semi")


def deduplicate_pixels(matches: DataFrame, key: list[str], confidence: str = "confidence", order: str = "ord") -> DataFrame:
    """Of the matches on a pixel the most confident, the earliest of equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(confidence), order)
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def thin(matches: DataFrame, error: str, cell: list[str], limit: int = 50, order: str = "ord", picture: list[str] | None = None) -> DataFrame:
    """The match with the least error of each cell, of these the `limit` best: of each picture (which its cells must name,
    too), or of all."""
    first = lambda w, n: F.row_number().over(w.orderBy(error, order)) <= n
    best = matches.withColumn("_r", first(Window.partitionBy(*cell), 1)).where("_r").drop("_r")
    if picture is None:
        return best.orderBy(error, order).limit(limit)
    return best.withColumn("_r", first(Window.partitionBy(*picture), limit)).where("_r").drop("_r")


def vote(points: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """The wall that most points with weight lie on, by weight, then count, then wall_id; accepted by VOTE.

    points (key, object_index, weight), objects (object_index, kind, wall_id)."""
    walls = objects.where(F.col("kind").isin("WallSurface", "Window", "Door") & F.col("wall_id").isNotNull()).select("object_index", "wall_id")
    seen = points.where("weight > 0").join(walls, "object_index", "left")
    n = seen.groupBy(key).agg(F.count("*").alias("positive"), F.count("wall_id").alias("on_walls"), F.sum(F.when(F.col("wall_id").isNotNull(), F.col("weight"))).alias("total"))
    by_wall = seen.where("wall_id IS NOT NULL").groupBy(key, "wall_id").agg(F.count("*").alias("votes"), F.sum("weight").alias("w"))
    first = Window.partitionBy(key).orderBy(F.desc("w"), F.desc("votes"), "wall_id")
    top = by_wall.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    out = n.join(top, key, "left").withColumns({"share": F.col("w") / F.col("total"), "visible": F.col("on_walls") / F.greatest("positive", F.lit(1))})
    ok = (F.col("votes") >= VOTE[0]) & (F.col("share") >= VOTE[1]) & (F.col("visible") >= VOTE[2])
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def geometry_score(holdout_fraction: Column, hull_fraction: Column) -> Column:
    return holdout_fraction * F.least(F.lit(1.0), hull_fraction / HULL_FULL)


def select_candidate(candidates: DataFrame, key: str) -> DataFrame:
    """The best candidate of each key and whether it is clear enough.

    candidates (key, ord, candidate_id, building_id, wall_id, score, gate_passed, vote_accepted). Rivals are scored
    candidates of another building or wall, also those that failed."""
    viable = candidates.where("gate_passed AND vote_accepted AND score IS NOT NULL")
    first = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    best = viable.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, F.col("candidate_id").alias("best_id"), F.col("building_id").alias("best_building"), F.col("wall_id").alias("best_wall"), F.col("score").alias("best_score"))
    both = candidates.join(best, key, "left")
    rival = F.col("best_id").isNotNull() & F.col("score").isNotNull() & ~(F.col("building_id").eqNullSafe(F.col("best_building")) & F.col("wall_id").eqNullSafe(F.col("best_wall")))
    out = both.groupBy(key).agg(*[F.first(c).alias(c) for c in ("best_id", "best_score")], F.max(F.when(rival, F.col("score"))).alias("runner_score"))
    margin = F.col("best_score") - F.coalesce("runner_score", F.lit(0.0))
    ok = (F.col("best_score") >= MIN_SCORE) & (margin >= MIN_MARGIN)
    reason = F.when(F.col("best_id").isNull(), "no_candidate_passed_geometry").when(ok, "automatic_checks_passed").otherwise("ambiguous_candidates")
    return out.withColumns({"margin": margin, "accepted": F.coalesce(ok, F.lit(False)), "reason": reason})


def confirmation_views(selected: DataFrame, seen: DataFrame, views: DataFrame, most: int = 2) -> DataFrame:
    """For each selected (building_id, wall_id), unseen views of it in which the wall is among the two largest and large
    enough. views (building_id, view_name, wall_id, pixels); seen (building_id, wall_id, view_name)."""
    by_view = Window.partitionBy("building_id", "view_name")
    walls = views.withColumns({"_r": F.row_number().over(by_view.orderBy(F.desc("pixels"), "wall_id")), "_top": F.max("pixels").over(by_view)})
    large = walls.where((F.col("_r") <= 2) & (F.col("pixels") >= F.greatest(F.lit(float(WALL_PIXELS)), F.col("_top") * WALL_SHARE))).drop("_r", "_top")
    fresh = large.join(selected, ["building_id", "wall_id"], "left_semi").join(seen, ["building_id", "wall_id", "view_name"], "left_anti")
    w = Window.partitionBy("building_id", "wall_id").orderBy(F.desc("pixels"), "view_name")
    return fresh.withColumn("choice", F.row_number().over(w)).where(F.col("choice") <= most)


def mutual_nearest(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs that are each other's nearest among pairs of like size within MATCH_DISTANCE.

    Both have key, id, x, y, w, h. b is filed in square cells of that side and a looks in its nine, so key and cell are
    the equi-join and a large key is no pile of all pairs; all else is a residual condition."""
    cell = lambda c: F.floor(F.col(c) / MATCH_DISTANCE)
    p = a.select(key, *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "w", "h")])
    p = p.withColumn("_i", F.explode(F.array(*[cell("a_x") + o for o in (-1, 0, 1)]))).withColumn("_j", F.explode(F.array(*[cell("a_y") + o for o in (-1, 0, 1)])))
    q = b.select(key, *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h")]).withColumns({"_i": cell("b_x"), "_j": cell("b_y")})
    p = p.join(q, [key, "_i", "_j"]).drop("_i", "_j")
    p = p.withColumn("distance", F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2)))
    like = F.lit(True)
    for c in ("w", "h"):
        like = like & F.try_divide(F.col(f"a_{c}"), F.col(f"b_{c}")).between(*MATCH_SIZE)
    p = p.where(like & (F.col("distance") <= MATCH_DISTANCE))
    r = lambda me, other: F.row_number().over(Window.partitionBy(key, f"{me}_id").orderBy("distance", f"{other}_id"))
    return p.withColumns({"ra": r("a", "b"), "rb": r("b", "a")}).where("ra = 1 AND rb = 1").drop("ra", "rb")


def spacing(points: DataFrame, key: str) -> DataFrame:
    """Distance of each point (key, id, x, y) to its nearest neighbour of the same key."""
    p = points.alias("a").join(points.alias("b"), F.expr(f"a.{key} = b.{key} AND a.id <> b.id"))
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return p.groupBy(F.col(f"a.{key}").alias(key), F.col("a.id").alias("id")).agg(F.min(d).alias("nearest"))


def agreement(errors: DataFrame, key: str | list[str], error: str = "error") -> DataFrame:
    """Median and 90th percentile (linear) of cross-view distances and whether they pass; no rows of a key: no pass."""
    return _passed(errors.groupBy(key).agg(F.count(error).alias("n"), F.percentile(error, 0.5).alias("median"), F.percentile(error, 0.9).alias("p90")))


def pair_agreement(a: DataFrame, b: DataFrame, key: str, match: str, value: str, scale: float = 1.0) -> DataFrame:
    """`agreement` of |a - b| / scale over all pairs of rows of a and b with equal key and match, without making the pairs,
    whose number grows with the square of the rows."""
    p = K.gap_percentiles(a, b, key, match, value, (0.5, 0.9), scale)
    return _passed(p.select(key, "n", F.get("at", F.lit(0)).alias("median"), F.get("at", F.lit(1)).alias("p90")))


def _passed(out: DataFrame) -> DataFrame:
    return out.withColumn("passed", F.coalesce((F.col("n") >= AGREEMENT[0]) & (F.col("median") <= AGREEMENT[1]) & (F.col("p90") <= AGREEMENT[2]), F.lit(False)))


def _viewed(selected: DataFrame, candidates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The selected candidates, and the passing ones that show their wall in another view; both with the wall's frame."""
    fields = ["building_id", "wall_id", "view_name", "h", "camera", *(c for c in ("photo_w", "photo_h") if c in candidates.columns)]
    frame = ["origin", "u", "v"]
    mine = selected.select(key, "candidate_id").join(candidates, [key, "candidate_id"]).select(key, "candidate_id", *fields, *frame)
    own = mine.select(key, "building_id", "wall_id", F.col("view_name").alias("_view"), *frame)
    passing = candidates.where("gate_passed AND vote_accepted").select(key, "candidate_id", *fields)
    others = passing.join(own, [key, "building_id", "wall_id"]).where("view_name <> _view").select(key, "candidate_id", *fields, *frame)
    return mine, others


def _on_wall(views: DataFrame, pixels: DataFrame, photo: tuple[int | Column, int | Column], key: str) -> DataFrame:
    """Where the photo's grid lies on the wall by each view (null: nowhere), and whether the wall is seen there."""
    nx, ny, lo, hi = AGREEMENT_GRID
    at = lambda i, n, size: (lo + i * (hi - lo) / (n - 1)) * size
    grid = F.array(*[F.struct(F.lit(r * nx + c).alias("i"), F.lit(at(c, nx, photo[0])).alias("x"), F.lit(at(r, ny, photo[1])).alias("y")) for r in range(ny) for c in range(nx)])
    p = views.withColumn("_g", F.explode(grid))
    p = p.withColumn("_p", N.project(F.col("_g.x"), F.col("_g.y"), [F.get("h", F.lit(i)) for i in range(9)]))
    p = p.withColumn("point", R.wall_point(F.col("_p.x"), F.col("_p.y"), F.col("camera"), F.col("origin"), F.col("u"), F.col("v")))
    p = p.withColumns({"_x": N.pixel(F.col("_p.x")).cast("long"), "_y": N.pixel(F.col("_p.y")).cast("long")})
    seen = pixels.select("building_id", "view_name", "wall_id", F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), F.lit(True).alias("_seen"))
    p = p.join(seen, ["building_id", "view_name", "wall_id", "_x", "_y"], "left")
    return p.select(key, "candidate_id", F.col("_g.i").alias("i"), "point", F.coalesce("_seen", F.lit(False)).alias("seen"))


def view_comparisons(selected: DataFrame, candidates: DataFrame, pixels: DataFrame, photo: tuple[int | Column, int | Column], key: str) -> DataFrame:
    """For each selected candidate and each passing one with the same wall in another view, how far apart in metres a grid
    over the photo lies on the wall by the two. Points count that both views see on the wall; sound: all have a place on it.

    selected (key, candidate_id), one row a key; candidates (key, candidate_id, building_id, wall_id, view_name,
    gate_passed, vote_accepted, h: photo to render by row, camera: pixel and depth to local, 4 x 4 by row, and origin, u, v
    of the wall, null if it is not planar); pixels (building_id, view_name, x, y, wall_id), once for each visible pixel."""
    mine, others = _viewed(selected, candidates, key)
    a, b = _on_wall(mine, pixels, photo, key), _on_wall(others, pixels, photo, key)
    both = b.alias("b").join(a.alias("a"), [key, "i"])
    gap = F.sqrt(sum((F.pow(F.col(f"a.point.{c}") - F.col(f"b.point.{c}"), 2) for c in "xyz"), F.lit(0.0)))
    both = both.select(key, "b.candidate_id", F.when(F.col("a.seen") & F.col("b.seen"), gap).alias("error"), (F.col("a.point").isNotNull() & F.col("b.point").isNotNull()).alias("met"))
    sound = both.groupBy(key, "candidate_id").agg(F.bool_and("met").alias("sound"))
    out = agreement(both, [key, "candidate_id"]).join(sound, [key, "candidate_id"])
    return out.withColumn("passed", F.col("passed") & F.col("sound"))


def view_agreement(selected: DataFrame, candidates: DataFrame, pixels: DataFrame, photo: tuple[int | Column, int | Column], key: str) -> DataFrame:
    """Whether at least one other passing view shows each selected wall and all such views agree with the selected one
    (see view_comparisons): one row for each selected candidate, with the reason why not."""
    n = view_comparisons(selected, candidates, pixels, photo, key).groupBy(key).agg(F.count("*").alias("comparisons"), F.bool_and("passed").alias("_all"), F.bool_and("sound").alias("_sound"))
    mine, _ = _viewed(selected, candidates, key)
    out = mine.select(key, "candidate_id", (F.col("origin").isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull()).alias("_planar")).join(n, key, "left")
    reason = F.when(F.col("comparisons").isNull(), "insufficient_cross_view_confirmation").when(~F.col("_planar"), "wall_not_supported_by_planar_reader").when(~F.col("_sound"), "invalid_wall_projection").when(~F.col("_all"), "views_disagree_on_world_position")
    out = out.withColumns({"comparisons": F.coalesce("comparisons", F.lit(0)), "reason": reason})
    return out.withColumns({"available": F.col("comparisons") > 0, "passed": F.col("reason").isNull()}).drop("_all", "_sound", "_planar")


def gates(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """metrics with checks (map), failed_checks (array) and gate_passed."""
    m = F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))])
    out = metrics.withColumn("checks", m).withColumn("failed_checks", F.map_keys(F.map_filter("checks", lambda _, v: ~v)))
    return out.withColumn("gate_passed", F.size("failed_checks") == 0)


def wall_crops(pixels: DataFrame) -> DataFrame:
    """The two largest walls of a view that are large enough, with their crops.

    pixels (view_id, wall_id, x, y, w, h): visible pixels and the image size."""
    by = pixels.groupBy("view_id", "wall_id").agg(F.count("*").alias("pixels"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))], F.max("w").alias("w"), F.max("h").alias("h"))
    v = Window.partitionBy("view_id")
    by = by.withColumns({"r": F.row_number().over(v.orderBy(F.desc("pixels"), "wall_id")), "top": F.max("pixels").over(v)})
    ok = (F.col("r") <= 2) & (F.col("pixels") >= F.greatest(F.lit(float(WALL_PIXELS)), F.col("top") * WALL_SHARE))
    side = (F.col("max_x") - F.col("min_x") >= WALL_SIDE) & (F.col("max_y") - F.col("min_y") >= WALL_SIDE)
    low = lambda c: F.greatest(F.col(f"min_{c}") - 4, F.lit(0))
    high = lambda c, s: F.least(F.col(f"max_{c}") + 5, F.col(s))
    return by.where(ok & side).select("view_id", "wall_id", "pixels", low("x").alias("x0"), low("y").alias("y0"), high("x", "w").alias("x1"), high("y", "h").alias("y1"))
