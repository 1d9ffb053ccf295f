"""Proximity in the plane: nearest, radius and heading filters over a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.boxes import finite
from quoin.functions.numeric import angle_between, bearing
from quoin.runtime import dealt

SHARES = 4
"""Shares of a cell of `within`, as many places may lie in one."""
LEVELS = 8
"""Grids of `nearest` below that with cells of the radius, each of half the side."""


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (a_id, b_id, distance, bearing from a to b) within radius. a, b: id, x, y.

    b is filed in square cells of half the radius and in shares of a cell, a looks in the 25 cells around it and in all shares;
    so the join has an equi-key, stays local, and is dealt evenly however few and small the files are."""
    side = radius * 1.0001 / 2
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(s).alias("share")) for i in range(-2, 3) for j in range(-2, 3) for s in range(SHARES)])
    p = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("o")).select("a_id", "ax", "ay", (cell("ax") + F.col("o.i")).alias("cx"), (cell("ay") + F.col("o.j")).alias("cy"), F.col("o.share").alias("share"))
    q = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"), F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("share"))
    p, q = (dealt(t, "cx", "cy", "share") for t in (p, q))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    out = p.hint("merge").join(q, ["cx", "cy", "share"]).withColumns({"distance": F.sqrt(dx * dx + dy * dy), "bearing": bearing(dx, dy)})
    return out.where(F.col("distance") <= radius).select("a_id", "b_id", "distance", "bearing")


def nearest(a: DataFrame, b: DataFrame, radius: float, k: int = 5) -> DataFrame:
    """The k nearest of b within radius of each a; ties by id. a, b: id, x, y.

    A place of a looks in the nine cells of a grid whose side fits the density around it: where the nine cells of a level
    hold k of b, these lie within three sides, and cells of four sides hold all that may be nearer. On a place of b only
    the k least ids count. So the pairs grow with the rows of a, also where b is dense; nothing is left out."""
    fine = radius * 1.0001 / (1 << LEVELS)
    cell = lambda c: F.floor(F.greatest(F.least(F.col(c) / fine, F.lit(4e18)), F.lit(-4e18))).cast("long")
    levels = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level")
    at = lambda level: [F.expr(f"shiftright(cx, {level})").alias("cx"), F.expr(f"shiftright(cy, {level})").alias("cy")]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    asked = a.where(finite(F.col("x"), F.col("y"))).select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    places = asked.select("ax", "ay").distinct().withColumns({"cx": cell("ax"), "cy": cell("ay")})
    same = Window.partitionBy("bx", "by").orderBy("b_id")
    q = b.where(finite(F.col("x"), F.col("y"))).select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    q = q.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r").withColumns({"cx": cell("bx"), "cy": cell("by")})

    held = q.groupBy("cx", "cy").agg(F.count("*").alias("n")).select("n", "cx", "cy", levels(LEVELS)).select("level", *at("level"), "n").groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"))
    nine = lambda p: p.select("*", around).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    seen = nine(places.select("ax", "ay", "cx", "cy", levels(LEVELS)).select("ax", "ay", "level", *at("level"))).hint("merge").join(held, ["level", "cx", "cy"])  # estimates know nothing of explode, and would broadcast
    seen = seen.groupBy("ax", "ay").agg(*[F.sum(F.when(F.col("level") == i, F.col("n"))).alias(f"n{i}") for i in range(LEVELS)])
    enough = F.coalesce(*[F.when(F.col(f"n{i}") >= k, F.lit(i)) for i in range(LEVELS)], F.lit(LEVELS))
    seen = seen.select("ax", "ay", enough.alias("_e"))
    limit = F.when(F.col("_e") < LEVELS, F.least(F.lit(radius), F.expr(f"{3 * fine!r}D * shiftleft(1, _e)"))).otherwise(F.lit(radius))
    fit = places.join(seen.hint("merge"), ["ax", "ay"], "left").withColumn("_e", F.coalesce("_e", F.lit(LEVELS)))
    fit = fit.select("ax", "ay", "cx", "cy", F.least(F.col("_e") + 2, F.lit(LEVELS)).alias("level"), limit.alias("within"))

    used = F.broadcast(fit.select("level").distinct())
    filed = q.crossJoin(used).select("b_id", "bx", "by", "level", *at("level"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    pairs = nine(fit.select("ax", "ay", "within", "level", *at("level"))).hint("merge").join(filed, ["level", "cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    w = Window.partitionBy("ax", "ay").orderBy("distance", "b_id")
    best = pairs.where(F.col("distance") <= F.col("within")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    out = asked.join(best, ["ax", "ay"]).withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("distance", "b_id"))).where(F.col("rank") <= k)
    return out.select("a_id", "b_id", "distance", bearing(dx, dy).alias("bearing"), "rank")


def facing(pairs: DataFrame, heading: str = "heading", fov: float = 90.0) -> DataFrame:
    """Pairs whose bearing is within half the field of view of the heading."""
    return pairs.where(angle_between(F.col("bearing"), F.col(heading)) <= fov / 2)
