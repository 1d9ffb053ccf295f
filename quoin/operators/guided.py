"""Matching by tiles, guided by a rough homography: which render crop each photo tile looks at, why tiles are skipped, and how
the matches of the others come back to whole images.

Whether a crop holds a pixel of an allowed wall is four lookups in a summed-area table of the view's wall pixels, kept as
rows of short blocks. So a tile costs four joined rows, however large its crop is, and keys are even: a view that many
photos are matched to is spread over its lines and blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import boxes as B
from quoin.functions import numeric as N
from quoin.runtime import cut, dealt

from . import detection as D
from . import matching as M
from . import raster as R

MARGIN, MIN_SIDE = 0.10, 32.0
BLOCK = 64
"""Columns of a row of the summed-area table."""
#: The reasons in their order.
REASONS = ("projective_pole_crosses_photo_tile", "nonfinite_projected_tile", "degenerate_projected_tile", "render_crop_outside_image_or_too_small", "no_allowed_wall_in_render_crop")


def summed_areas(walls: DataFrame, views: DataFrame) -> DataFrame:
    """(view_id, y, block, sums): how many of a view's wall pixels lie above y and left of x, for x from block * BLOCK on;
    blocks of zeros are left out.

    walls (view_id, x, y) once for each pixel, views (view_id, w, h). A task holds one view, which its size bounds."""
    kind = walls.schema["view_id"].dataType.simpleString()

    def run(size: pa.Table, pixels: pa.Table) -> pa.Table:
        out = {"view_id": [], "y": [], "block": [], "sums": []}
        if size.num_rows and pixels.num_rows:
            w, h = size["w"][0].as_py(), size["h"][0].as_py()
            wide = -(-(w + 1) // BLOCK) * BLOCK
            s = np.zeros((h + 1, wide), dtype=np.int32)
            x, y = pixels["x"].to_numpy(), pixels["y"].to_numpy()
            ok = (x >= 0) & (y >= 0) & (x < w) & (y < h)
            s[y[ok] + 1, x[ok] + 1] = 1
            s = s.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32).reshape(h + 1, -1, BLOCK)
            rows, blocks = np.nonzero(s.any(axis=2))
            out = {"view_id": [size["view_id"][0].as_py()] * len(rows), "y": rows.astype(np.int32), "block": blocks.astype(np.int32), "sums": pa.ListArray.from_arrays(np.arange(0, len(rows) * BLOCK + 1, BLOCK, dtype=np.int32), s[rows, blocks].ravel())}
        return pa.table(out, schema=pa.schema([size.schema.field("view_id"), ("y", pa.int32()), ("block", pa.int32()), ("sums", pa.list_(pa.int32()))]))

    left = views.select("view_id", F.col("w").cast("int"), F.col("h").cast("int")).groupBy("view_id")
    right = walls.select("view_id", F.col("x").cast("int"), F.col("y").cast("int")).groupBy("view_id")
    return left.cogroup(right).applyInArrow(run, f"view_id {kind}, y int, block int, sums array<int>")


def wall_pixels(crops: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """key, n: how many wall pixels lie in each crop (view_id, cx0, cy0, cx1, cy1; the last column and line excluded)."""
    corner = lambda x, y, sign: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(sign).alias("sign"))
    four = F.array(corner("cx1", "cy1", 1), corner("cx0", "cy1", -1), corner("cx1", "cy0", -1), corner("cx0", "cy0", 1))
    c = crops.select(*key, "view_id", F.explode(four).alias("_c")).select(*key, "view_id", F.col("_c.y").alias("y"), F.floor(F.col("_c.x") / BLOCK).cast("int").alias("block"), (F.col("_c.x") % BLOCK).alias("_at"), F.col("_c.sign").alias("_sign"))
    got = c.join(sums, ["view_id", "y", "block"], "left")
    return got.groupBy(*key).agg(F.sum(F.col("_sign") * F.coalesce(F.get("sums", F.col("_at")), F.lit(0))).alias("n"))


def crops(pairs: DataFrame, pair: str) -> DataFrame:
    """The photo's tiles with the render crop of each (cx0..cy1), or the first of the first four reasons as skip_reason.

    pairs (pair, photo_w, photo_h, render_w, render_h, h: photo to render by row, view_id)."""
    t = D.tiles(dealt(pairs), "photo_w", "photo_h")
    box = B.Box(*(F.col(c) - 0.5 for c in ("x0", "y0", "x1", "y1")))  # a crop begins half a pixel before its first centre
    size = F.sqrt(F.aggregate("h", F.lit(0.0), lambda a, x: a + x * x))
    t = t.withColumn("_h", F.transform("h", lambda x: x / size))
    h = [F.get("_h", F.lit(i)) for i in range(9)]
    at = F.array(*[F.struct(x.alias("x"), y.alias("y"), (x * h[6] + y * h[7] + h[8]).alias("w")) for x, y in R.corners(box)])
    t = t.withColumn("_c", at).withColumn("_p", F.transform("_c", lambda c: N.project(c["x"], c["y"], h)))
    side = lambda f: F.coalesce(F.forall("_c", f), F.lit(False))
    pole = ~(side(lambda c: c["w"] > R.POLE) | side(lambda c: c["w"] < -R.POLE))
    known = F.forall("_p", lambda p: p.isNotNull())
    t = t.withColumns({f"_{f}{c}": F.when(known, g(F.col(f"_p.{c}"))) for f, g in (("a", F.array_min), ("b", F.array_max)) for c in "xy"})
    span = {c: F.col(f"_b{c}") - F.col(f"_a{c}") for c in "xy"}
    edge = {"x": F.col("render_w"), "y": F.col("render_h")}
    low = {c: F.greatest(F.col(f"_a{c}") - MARGIN * span[c], F.lit(-0.5)) for c in "xy"}
    high = {c: F.least(F.col(f"_b{c}") + MARGIN * span[c], edge[c] - 0.5) for c in "xy"}
    area = F.abs(N.signed_area(F.col("_p")))
    reason = (
        F.when(pole, REASONS[0]).when(~F.coalesce(known, F.lit(False)), REASONS[1]).when((span["x"] < 1) | (span["y"] < 1) | (area < 1), REASONS[2])
        .when((high["x"] - low["x"] < MIN_SIDE) | (high["y"] - low["y"] < MIN_SIDE), REASONS[3])
    )
    t = t.withColumn("skip_reason", reason)
    whole = lambda c: F.when(F.col("skip_reason").isNull(), c).cast("int")
    t = t.withColumns({f"c{c}{i}": whole(v) for c in "xy" for i, v in enumerate((F.floor(low[c] + 0.5), F.ceil(high[c] + 0.5)))})
    return t.select(pair, "view_id", "photo_w", "photo_h", "render_w", "render_h", "name", "x0", "y0", "x1", "y1", "cx0", "cy0", "cx1", "cy1", "skip_reason")


def plan_tiles(pairs: DataFrame, walls: DataFrame, views: DataFrame, pair: str = "pair") -> DataFrame:
    """crops() with all five reasons: crops without a pixel of an allowed wall are skipped, too, and have n_wall 0."""
    t = cut(crops(pairs, pair))
    n = wall_pixels(t.where("skip_reason IS NULL"), summed_areas(walls, views), [pair, "name"])
    out = t.join(n.withColumnRenamed("n", "n_wall"), [pair, "name"], "left")
    return out.withColumn("skip_reason", F.when(F.col("n_wall") == 0, REASONS[4]).otherwise(F.col("skip_reason")))


def restored(planned: DataFrame, raw: DataFrame, walls: DataFrame, pair: str = "pair") -> DataFrame:
    """The usable matches of all tiles in pixels of the whole photo (px, py) and render (rx, ry).

    raw (pair, name, ord, ax, ay, bx, by: -1 to 1 over the edges of the two crops, overlap)."""
    m = raw.join(planned.where("skip_reason IS NULL"), [pair, "name"])
    size = {"a": (F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "b": (F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0"))}
    m = m.withColumns({f"_{s}{c}": N.to_pixels(F.col(f"{s}{c}"), size[s][i], F.lit(0)) for s in "ab" for i, c in enumerate("xy")})
    within = N.inside(F.col("_ax"), F.col("_ay"), *size["a"]) & N.inside(F.col("_bx"), F.col("_by"), *size["b"])
    m = m.where(within & N.finite(F.col("overlap")) & (F.col("overlap") >= M.MIN_CONFIDENCE))
    m = m.select(pair, "name", "ord", "view_id", "overlap", "photo_w", "photo_h", "render_w", "render_h", *[(F.col(f"_{s}{c}") + F.col(f"{o}{c}0")).alias(f"{n}{c}") for s, o, n in (("a", "", "p"), ("b", "c", "r")) for c in "xy"])
    m = m.where(N.inside(F.col("px"), F.col("py"), F.col("photo_w"), F.col("photo_h")) & N.inside(F.col("rx"), F.col("ry"), F.col("render_w"), F.col("render_h")))
    on = walls.select("view_id", F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y")).distinct()
    m = m.withColumns({"_x": N.pixel(F.col("rx")), "_y": N.pixel(F.col("ry"))}).join(on, ["view_id", "_x", "_y"], "left_semi")
    return m.select(pair, "name", "ord", "px", "py", "rx", "ry", "overlap")


def guided_matches(planned: DataFrame, raw: DataFrame, failed: DataFrame, walls: DataFrame, pair: str = "pair") -> tuple[DataFrame, DataFrame]:
    """The matches that stay, of those on one photo pixel the most sure one (then the first tile's), and a report of tiles.

    planned: plan_tiles; failed (pair, name): tiles whose matching failed. A tile of the report is skipped, failed or
    completed, with its raw matches and those kept before and after the choice by pixel."""
    usable = restored(planned, raw.join(failed, [pair, "name"], "left_anti"), walls, pair)
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    spot = Window.partitionBy(pair, N.pixel(F.col("px")), N.pixel(F.col("py"))).orderBy(F.desc("overlap"), number, "ord")
    chosen = cut(usable.withColumn("_r", F.row_number().over(spot)).withColumn("kept", F.col("_r") == 1).drop("_r"))
    n = chosen.groupBy(pair, "name").agg(F.count("*").alias("kept_before"), F.count_if("kept").alias("kept_after"))
    given = raw.groupBy(pair, "name").agg(F.count("*").alias("raw_matches"))
    report = planned.select(pair, "name", "skip_reason").join(failed.select(pair, "name", F.lit(True).alias("_failed")).distinct(), [pair, "name"], "left")
    state = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("_failed"), "failed").otherwise("completed")
    report = report.withColumn("status", state).drop("_failed").join(n, [pair, "name"], "left").join(given, [pair, "name"], "left")
    completed = F.col("status") == "completed"
    counts = {c: F.when(completed, F.coalesce(c, F.lit(0).cast("long"))) for c in ("raw_matches", "kept_before", "kept_after")}
    return chosen.where("kept").drop("kept"), report.withColumns(counts)


def overall(report: DataFrame, pair: str = "pair") -> DataFrame:
    """Of each pair its tiles by outcome, matches before and after the choice by pixel, and the status: complete only if every
    tile is."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "skipped")]
    sums: list[Column] = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept_before", "kept_after")]
    out = report.groupBy(pair).agg(F.count("*").alias("tiles"), *by, *sums)
    return out.withColumn("status", F.when(F.col("kept_after") == 0, "no_matches").when(F.col("completed") == F.col("tiles"), "complete").otherwise("partial"))
