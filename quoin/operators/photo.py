"""From the evaluated candidates of many photos to windows and doors on 3D walls, in one plan.

For each photo the best candidate is chosen and must be clear of its rivals; other views of its wall must agree with it; only
then its detections are mapped. Each photo ends with one status and the reason for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import cut

from . import mapping as G
from . import matching as M
from . import state as S

KEY = "photo_id"


def seen_walls(pixels: DataFrame, objects: DataFrame) -> DataFrame:
    """(building_id, view_name, x, y, wall_id): pixels on walls, or on openings, which count for their wall."""
    walls = objects.where(F.col("kind").isin(*G.WALL_KINDS) & F.col("wall_id").isNotNull()).select("building_id", "object_index", "wall_id")
    return pixels.join(walls, ["building_id", "object_index"]).select("building_id", "view_name", "x", "y", "wall_id")


def wanted_views(candidates: DataFrame, views: DataFrame) -> DataFrame:
    """Views that should be matched, too: for photos whose best candidate is clear but shown by no other passing view, up to
    two unseen views of its wall (views: building_id, view_name, wall_id, pixels)."""
    best = _best(candidates)
    passing = candidates.where("gate_passed AND vote_accepted").select(KEY, "building_id", "wall_id", F.col("view_name").alias("_other"))
    confirmed = best.join(passing, [KEY, "building_id", "wall_id"]).where("_other <> view_name").select(KEY).distinct()
    open_ = cut(best.join(confirmed, KEY, "left_anti").select(KEY, "building_id", "wall_id"))
    # photos of one wall may have seen different views of it, so each photo and wall has a name of its own
    name = F.to_json(F.struct(F.col(KEY), F.col("building_id")))
    by_photo = lambda d: d.withColumn("building_id", name)
    mine = open_.select(KEY, "building_id", "wall_id").join(views, ["building_id", "wall_id"]).select("building_id", KEY).distinct()
    shown = by_photo(mine.join(views, "building_id")).drop(KEY)
    seen = by_photo(candidates.select(KEY, "building_id", "wall_id", "view_name"))
    chosen = M.confirmation_views(by_photo(open_).select("building_id", "wall_id"), seen.select("building_id", "wall_id", "view_name"), shown)
    names = open_.select(KEY, F.col("building_id").alias("_building"), name.alias("building_id"))
    return chosen.join(names.distinct(), "building_id").select(KEY, F.col("_building").alias("building_id"), "wall_id", "view_name", "choice")


def _best(candidates: DataFrame) -> DataFrame:
    accepted = M.select_candidate(candidates, KEY).where("accepted").select(KEY, F.col("best_id").alias("candidate_id"))
    return accepted.join(candidates, [KEY, "candidate_id"])


def locate(photos: DataFrame, candidates: DataFrame, detections: DataFrame, rings: DataFrame, pixels: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses, mapped): one row for each photo with status, reason, selected candidate and counts; and the detections of
    photos with a selected candidate as by mapping.map_runs.

    photos (photo_id, photo_w, photo_h, error: why its run failed, or null); candidates (photo_id, candidate_id, ord,
    building_id, wall_id, view_name, score, gate_passed, vote_accepted, h, camera, origin, u, v, render_w, render_h);
    detections (photo_id, ord, class, box); rings (wall_id, ring_id, points); pixels (building_id, view_name, x, y,
    object_index); objects (building_id, object_index, kind, wall_id)."""
    sized = cut(candidates.join(photos.where("error IS NULL").select(KEY, "photo_w", "photo_h"), KEY))
    choice = cut(M.select_candidate(sized, KEY).select(KEY, "best_id", "best_score", "margin", "accepted", F.col("reason").alias("_choice")))
    picked = choice.where("accepted").select(KEY, F.col("best_id").alias("candidate_id"))
    agree = M.view_agreement(picked, sized, seen_walls(pixels, objects), (F.col("photo_w"), F.col("photo_h")), KEY)
    agree = cut(agree.select(KEY, "candidate_id", "comparisons", F.col("passed").alias("_agrees"), F.col("reason").alias("_views")))
    view = F.concat_ws("/", "building_id", "view_name")
    runs = agree.where("_agrees").select(KEY, "candidate_id").join(sized, [KEY, "candidate_id"])
    runs = runs.select(KEY, "photo_w", "photo_h", "render_w", "render_h", "h", "camera", "origin", "u", "v", view.alias("view_id"), "building_id", "wall_id")
    mapped = cut(G.map_runs(detections, runs, rings, pixels.select(view.alias("view_id"), "x", "y", "object_index"), objects, KEY))
    ok = F.col("reject_reason").isNull()
    refused = F.col("reject_reason").isNotNull() & ~F.col("reject_reason").isin(*G.REASONS)  # by the run, not by the box
    n = mapped.groupBy(KEY).agg(F.count_if(ok).alias("mapped_count"), F.count_if(~ok).alias("rejected_count"), F.max(F.when(refused, F.col("reject_reason"))).alias("mapping_error"))
    out = photos.select(KEY, "error").join(choice, KEY, "left").join(agree.drop("candidate_id"), KEY, "left").join(n, KEY, "left")
    selected = F.when(F.col("_agrees") & F.col("mapping_error").isNull(), F.col("best_id"))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("best_id").isNull(), "no_candidate_passed_geometry")
        .when(~F.col("accepted"), F.col("_choice")).when(~F.col("_agrees"), F.col("_views")).when(F.col("mapping_error").isNotNull(), "invalid_mapping_geometry")
        .otherwise("automatic_checks_passed")
    )
    out = out.withColumns({"selected_id": selected, "reason": reason, "finished": F.lit(True)})
    place = sized.select(KEY, F.col("candidate_id").alias("selected_id"), "building_id", "wall_id", "view_name")
    told = S.mapping_status(out).join(place, [KEY, "selected_id"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.select(KEY, "status", "reason", "selected_id", "building_id", "wall_id", "view_name", "best_score", "margin", count("comparisons"), count("mapped_count"), count("rejected_count"), "mapping_error"), mapped
