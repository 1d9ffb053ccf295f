"""Detections: validation, tiling, overlap joins, greedy grouping, counts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import boxes as B

TILE, OVERLAP = (1200, 1000), 300


def validate(raw: DataFrame) -> DataFrame:
    """raw (category, score, x0..y1, tile box tx0..ty1, image size w, h) with class, full box and reject_reason: first what is
    no number or no score, then the category, then boxes that the tile cuts or that are empty; rejected rows stay."""
    c = B.category(F.col("category"))
    tile = B.Box(*(F.col(k) for k in ("tx0", "ty0", "tx1", "ty1")))
    local = B.Box.at()
    full = B.to_full(local, tile, F.col("w"), F.col("h"))
    sound = B.finite(local.x0, local.y0, local.x1, local.y1) & B.finite(F.col("score")) & F.col("score").between(0, 1)
    reason = F.when(~F.coalesce(sound, F.lit(False)), "invalid_bbox_or_score").when(~F.coalesce(c.isin(*B.CATEGORIES), F.lit(False)), "unexpected_category").when(full.isNull(), "invalid_or_internal_tile_edge")
    return raw.withColumns({"class": c, "full": F.when(reason.isNull(), full), "reject_reason": reason})


def starts(length: Column, size: int, overlap: int = OVERLAP) -> Column:
    """Tile starts along one side: regular steps, the last flush with the edge."""
    last = length - size
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(size - overlap))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(last))))


def tiles(images: DataFrame, width: str = "width", height: str = "height", tile: tuple[int, int] = TILE, overlap: int = OVERLAP) -> DataFrame:
    """One row for each tile (name, x0..y1), in row-major order."""
    w, h = F.col(width).cast("int"), F.col(height).cast("int")
    out = images.withColumn("ys", starts(h, tile[1], overlap)).withColumn("xs", starts(w, tile[0], overlap))
    out = out.select("*", F.posexplode("ys").alias("row", "y0")).select("*", F.posexplode("xs").alias("column", "x0"))
    number = F.col("row") * F.size("xs") + F.col("column") + 1
    return out.select(*images.columns, F.concat(F.lit("tile_"), number.cast("string")).alias("name"), "x0", "y0", F.least(F.col("x0") + tile[0], w).alias("x1"), F.least(F.col("y0") + tile[1], h).alias("y1"))


def pairs(det: DataFrame, image: str = "img", order: str = "ord") -> DataFrame:
    """Pairs of detections of an image (columns a.*, b.*), the earlier first. The equi-join keeps pairs inside an image."""
    return det.alias("a").join(det.alias("b"), F.expr(f"a.{image} = b.{image} AND a.{order} < b.{order}"))


def deduplicate(det: DataFrame, image: str = "img") -> DataFrame:
    """Greedy complete-linkage groups of an image's detections (kind, score, box): best score first, ties by (kind, box);
    each joins the first group in which it is the same opening as every member, else opens one.

    One row for each group with its representative, class (ambiguous if kinds differ), candidates and class_scores."""
    item = F.struct((-F.col("score")).alias("neg"), "kind", "x0", "y0", "x1", "y1")
    kind = "array<array<struct<neg:double,kind:string,x0:double,y0:double,x1:double,y1:double>>>"

    def place(groups: Column, r: Column) -> Column:
        fits = lambda g: F.forall(g, lambda o: B.same_opening(B.Box.of(r), B.Box.of(o)))
        hit = F.array_position(F.transform(groups, fits), True)
        return F.when(hit > 0, F.transform(groups, lambda g, i: F.when(i + 1 == hit, F.concat(g, F.array(r))).otherwise(g))).otherwise(F.concat(groups, F.array(F.array(r))))

    out = det.groupBy(image).agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = out.select(image, F.posexplode(F.aggregate("items", F.array().cast(kind), place)).alias("grp", "members"))
    first, kinds = F.get("members", F.lit(0)), F.array_sort(F.array_distinct(F.transform("members", lambda m: m["kind"])))
    scores = F.transform(kinds, lambda k: F.struct(k.alias("key"), F.array_max(F.transform(F.filter("members", lambda m: m["kind"] == k), lambda m: -m["neg"])).alias("value")))
    return out.select(
        image, "grp", F.when(F.size(kinds) > 1, "ambiguous").otherwise(first["kind"]).alias("class"), (-first["neg"]).alias("score"),
        *[first[c].alias(c) for c in ("x0", "y0", "x1", "y1")], F.size("members").alias("n_candidates"),
        (F.size(kinds) > 1).alias("review_required"), F.map_from_entries(scores).alias("class_scores"), F.col("members").alias("candidates"),
    )


def counts(det: DataFrame, image: str = "img", kind: str = "class") -> DataFrame:
    return det.groupBy(image).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in (*B.CATEGORIES, "ambiguous")], F.count("*").alias("n"))


def interop(det: DataFrame, image: str = "img") -> DataFrame:
    """Per image, the boxes of each class as JSON arrays of whole pixels, in reading order; ambiguous ones left out."""
    box = F.array(*[F.round(c).cast("long") for c in ("x0", "y0", "x1", "y1")])
    cell = lambda k: F.to_json(F.array_sort(F.collect_list(F.when(F.col("class") == k, box)))).alias(k)
    return det.where(F.col("class") != "ambiguous").groupBy(image).agg(cell("window"), cell("door"))


def merge_tiles(raw: DataFrame, image: str = "img") -> tuple[DataFrame, DataFrame]:
    """The detections of all tiles (see validate) as groups of an image, and each image's numbers: raw, rejected, groups."""
    judged = validate(raw)
    sound = judged.where("reject_reason IS NULL").select(image, F.col("class").alias("kind"), "score", "full.*")
    groups = deduplicate(sound, image)
    seen = judged.groupBy(image).agg(F.count("*").alias("n_raw"), F.count("reject_reason").alias("n_rejected"))
    return groups, seen.join(groups.groupBy(image).agg(F.count("*").alias("n_groups")), image, "left").fillna(0, ["n_groups"])


def lookup(photos: DataFrame, batches: DataFrame, detections: DataFrame) -> DataFrame:
    """photos (photo_id, sha256, w, h, coordinate_system) with the detection file of the latest batch that has them.

    The batch with the greatest `seq` is the one that counts; a photo it does not know by all four gets a reject_reason."""
    last = detections.join(batches.agg(F.max_by("batch_id", "seq").alias("batch_id")), "batch_id", "left_semi")
    key = ["sha256", "w", "h", "coordinate_system"]
    out = photos.join(last.groupBy(*key).agg(F.max("path").alias("path")), key, "left")
    return out.withColumn("reject_reason", F.when(F.col("path").isNull(), "no_detection_of_this_image"))


def mapped_counts(mapped: DataFrame, run: str, kind: str = "class", reason: str = "reject_reason") -> DataFrame:
    """Mapped detections of each class, and how many were mapped and rejected."""
    ok = F.col(reason).isNull()
    return mapped.groupBy(run).agg(*[F.count_if(ok & (F.col(kind) == k)).alias(f"n_{k}") for k in (*B.CATEGORIES, "ambiguous")], F.count_if(ok).alias("mapped"), F.count_if(~ok).alias("rejected"))
