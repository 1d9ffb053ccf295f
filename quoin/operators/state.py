"""Identity, caches, job states and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(**parts: Column) -> Column:
    """SHA-256 of named values in the order of their names: the key of caches and resumed runs."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def reuse(requests: DataFrame, cache: DataFrame, key: list[str], owned: str = "owned", path: str = "path") -> DataFrame:
    """requests with the cache entry of equal key that comes first: owned ones, then by path downwards; null: a miss."""
    w = Window.partitionBy(*key).orderBy(F.desc(owned), F.desc(path))
    first = cache.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return requests.join(first, key, "left")


def latest_state(log: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key of an append-only log."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(*key, "_s.*")


def roll_up(items: DataFrame, run: str, state: str = "state", done: str = "completed", failed: str = "failed") -> DataFrame:
    """Counts of a run's items by state and its overall status."""
    out = items.groupBy(run).agg(F.count_if(F.col(state) == done).alias("n_complete"), F.count_if(F.col(state) == failed).alias("n_failed"), F.count("*").alias("n"))
    out = out.withColumn("n_pending", F.col("n") - F.col("n_complete") - F.col("n_failed"))
    status = F.when(F.col("n_complete") == F.col("n"), "complete").when(F.col("n_pending") > 0, "running").otherwise("partial")
    return out.withColumn("status", status)


def batch_outcome(items: DataFrame, run: str, state: str = "state", done: str = "success", failed: str = "failed") -> DataFrame:
    """Status of a batch that goes on after a failure: running, completed, completed_with_errors."""
    out = items.groupBy(run).agg(F.count("*").alias("n"), F.count_if(F.col(state) == done).alias("n_done"), F.count_if(F.col(state) == failed).alias("n_failed"))
    status = F.when(F.col("n_done") + F.col("n_failed") < F.col("n"), "running").when(F.col("n_failed") > 0, "completed_with_errors").otherwise("completed")
    return out.withColumn("status", status)


def mapping_status(runs: DataFrame) -> DataFrame:
    """runs (finished, error, selected_id, mapping_error, mapped_count) with their status. error: of the run itself;
    mapping_error: the mapping of the selected candidate was refused."""
    status = (
        F.when(F.col("error").isNotNull(), "failed").when(~F.coalesce("finished", F.lit(False)), "running")
        .when(F.col("selected_id").isNull() | F.col("mapping_error").isNotNull(), "needs_review")
        .when(F.coalesce("mapped_count", F.lit(0)) > 0, "mapped").otherwise("no_detections_mapped")
    )
    return runs.withColumn("status", status)


#: Stages of a render in their order; a failed one keeps the stage that it failed in.
RENDER_STAGES = ("loading_model", "rendering_views", "contact_sheet", "complete")


def render_state(log: DataFrame, key: str) -> DataFrame:
    """Stage and status (running, complete, failed) of each render of an append-only log (key, seq, stage or 'failed')."""
    staged = F.col("stage").isin(*RENDER_STAGES)
    out = log.groupBy(key).agg(F.max_by(F.when(staged, F.col("stage")), F.when(staged, F.col("seq"))).alias("at"), F.max_by("stage", "seq").alias("last"))
    status = F.when(F.col("last") == "failed", "failed").when(F.col("last") == "complete", "complete").otherwise("running")
    return out.select(key, F.col("at").alias("stage"), status.alias("status"))


def missing_outputs(items: DataFrame, listing: DataFrame, required: list[str], key: str = "item") -> DataFrame:
    """Items of which a required file (listing: key, file) is absent."""
    want = items.select(key, F.explode(F.array(*map(F.lit, required))).alias("file"))
    return want.join(listing.select(key, "file"), [key, "file"], "left_anti").groupBy(key).agg(F.sort_array(F.collect_list("file")).alias("missing"))


def grouped_split(group: Column, shares: dict[str, int]) -> Column:
    """A split by arithmetic on an integer group, so that no group is in two splits."""
    total = sum(shares.values())
    h = F.pmod(group.cast("long") * 2654435761, F.lit(4294967296)) % total
    out, at = F.lit(None).cast("string"), total
    for name, n in reversed(shares.items()):
        out = F.when(h < at, F.lit(name)).otherwise(out)
        at -= n
    return out


def precision_coverage(scored: DataFrame, thresholds: list[float], score: str = "score", correct: str = "correct") -> DataFrame:
    """For each threshold, the share of rows that reach it and the share of these that are correct."""
    t = scored.select(F.col(score).alias("s"), F.col(correct).alias("c"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    taken = F.col("s") >= F.col("threshold")
    out = t.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(taken).alias("accepted"), F.count_if(taken & F.col("c")).alias("right"))
    return out.withColumns({"coverage": F.col("accepted") / F.col("n"), "precision": F.try_divide("right", "accepted")})


def progress(items: DataFrame, status: str = "status") -> DataFrame:
    """Items by status: what a progress index shows after each of them."""
    return items.groupBy(status).agg(F.count("*").alias("n"))


def gallery_rows(buildings: DataFrame, building: str = "building_id") -> DataFrame:
    """One row for each view and visible wall of complete buildings (views: array of structs view_name, walls)."""
    v = buildings.where("status = 'complete'").select(building, F.explode("views").alias("v"))
    return v.select(building, "v.view_name", F.explode("v.walls").alias("wall_id"))


def evaluated(results: DataFrame, expected: DataFrame, photo: str = "photo_id") -> DataFrame:
    """results (photo, building_id, status) against the expected building of the photo; only after inference."""
    truth = expected.select(photo, F.col("building_id").alias("expected_id"))
    return results.join(truth, photo).withColumn("correct", F.col("building_id").eqNullSafe(F.col("expected_id")))
