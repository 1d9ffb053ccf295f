"""Operator 7: mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic), the only table that is raked: each round scales the cells so
that the marginals of one dimension meet their targets, dimension after dimension. A cell's weight is its raked share
over its share of tokens; documents are drawn with probability min(1, scale * weight), where the scale is calibrated so
that `budget` of all tokens are expected to stay, whatever is clipped at 1. The draw compares a hash of doc_id with the
probability, so it is the same at every run and partitioning.

Everything is DataFrame operations. The cells are written to the shared folder; they are broadcast only if Spark finds
their file below its threshold, else joined by key, where a hot cell is split by AQE.

Null sources and languages are values of their own; null or empty texts have no tokens, weight as their cell and are
drawn like others; rows without doc_id share one draw, as do rows that repeat one; texts are counted whole, however long;
an empty table gives an empty result. Columns of docs may have any name: those that are added take names that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, stored

ROUNDS = 6
CALIBRATIONS = 5
BUDGET = 0.75
#: A target is the marginal's share of tokens to this power, scaled to one: below 1 it lifts small sources.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SALT = "mix"


def tokens(text: Column) -> Column:
    """Runs of anything but space and the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    """A coarse form of the text, as documents have no topic of their own: brief, contact, lines or prose."""
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(n < 50, "brief").when(F.instr(text, "@") > 0, "contact").when(lines * 40 > n, "lines").otherwise("prose")


def rake(cells: DataFrame, dims: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """cells (dims and positive doubles t) with w, raked to tempered marginals of t."""
    total = Window.partitionBy(F.lit(0))
    out = cells.withColumn("w", F.col("t"))
    for d, power in dims.items():
        by = Window.partitionBy(d)
        share = cells.groupBy(d).agg(F.sum("t").alias("m"))
        share = share.withColumn("target", F.pow("m", F.lit(power))).withColumn("target", F.col("target") / F.sum("target").over(total)).drop("m")
        out = out.join(share.withColumnRenamed("target", f"target_{d}"), d)
    for _ in range(rounds):
        for d in dims:
            out = out.withColumn("w", F.col("w") * F.col(f"target_{d}") / F.sum("w").over(Window.partitionBy(d)))
    return out.select(*dims, "t", "w")


def weighted(docs: DataFrame, dims: dict[str, float], n: str, budget: float = BUDGET, rounds: int = ROUNDS, names: tuple[str, str] = ("weight", "probability")) -> DataFrame:
    """docs with `names`, by default weight and probability; dims: columns of docs to the power of their targets; n: column of tokens."""
    plain = docs.groupBy(*[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims], *[F.col(d).isNull().alias(f"no_{d}") for d in dims]).agg(F.sum(n).cast("double").alias("t"))
    keys = {d: F.when(F.col(f"no_{d}"), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(d))) for d in dims}
    cells = stored(plain.select(*[k.alias(d) for d, k in keys.items()], "t"), "cells")
    full = stored(rake(cells.where("t > 0"), dims, rounds), "raked")
    total = full.agg(F.sum("t").alias("all_t"), F.sum("w").alias("all_w"))  # one row
    weights = full.crossJoin(F.broadcast(total)).withColumn("weight", (F.col("w") / F.col("all_w")) / (F.col("t") / F.col("all_t"))).drop("w", "all_w")
    scale = weights.select(F.lit(float(budget)).alias("scale")).distinct()
    for _ in range(CALIBRATIONS):
        # clipped cells stay whole; the others share what is left of the budget
        rest = weights.crossJoin(F.broadcast(scale)).agg(
            F.first("all_t").alias("a"), F.sum(F.when(F.col("scale") * F.col("weight") >= 1, F.col("t")).otherwise(0.0)).alias("c"), F.sum(F.when(F.col("scale") * F.col("weight") < 1, F.col("t") * F.col("weight"))).alias("o"), F.first("scale").alias("s")
        )
        scale = rest.select(F.coalesce(F.greatest("s", (F.col("a") * budget - F.col("c")) / F.col("o")), F.col("s")).alias("scale"))
    chances = stored(weights.crossJoin(F.broadcast(scale)).select(*dims, F.round("weight", 6).alias("weight"), F.round(F.least(F.lit(1.0), F.col("scale") * F.col("weight")), 6).alias("probability")), "chances")
    renamed = dict(zip(dims, fresh(docs, *[f"key_{d}" for d in dims]), strict=True))
    keyed = docs.withColumns({renamed[d]: F.when(F.col(d).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(d).cast("string"))) for d in dims})
    right = chances.select(*[F.col(d).alias(renamed[d]) for d in dims], F.col("weight").alias(names[0]), F.col("probability").alias(names[1]))
    out = keyed.join(right, list(renamed.values()), "left").drop(*renamed.values())
    return out.withColumns({names[0]: F.coalesce(names[0], F.lit(1.0)), names[1]: F.coalesce(names[1], F.lit(float(budget)))})


def drawn(doc_id: Column, probability: Column) -> Column:
    """Whether a document is drawn: 32 bits of a hash of its id, as a fraction, below the probability."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0 < probability


def mix(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, tokens, topic, weight, probability and kept for each row of docs (doc_id, text, source, lang)."""
    base = docs.select("doc_id", F.col("source").alias("source"), F.col("lang").alias("lang"), tokens(F.col("text")).alias("tokens"), "text")
    base = base.select("doc_id", "source", "lang", "tokens", F.when(F.col("text").isNull(), "brief").otherwise(topic(F.col("text"), F.col("tokens"))).alias("topic"))
    base = stored(base, "counted")  # the texts are walked once; what follows needs these few numbers of each
    out = weighted(base, TEMPER, "tokens", budget)
    return out.select("doc_id", "tokens", "topic", "weight", "probability", drawn(F.col("doc_id"), F.col("probability")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document with its weight, its probability and whether it is drawn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))


def oracle(budget: float = BUDGET) -> str:
    """The same in DuckDB SQL: one common table expression for each step of each round."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    q = [
        f"d0 AS (SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang, text, CAST({words} AS BIGINT) AS tokens FROM documents)",
        "d AS (SELECT doc_id, source, lang, tokens, '=' || CASE WHEN tokens < 50 THEN 'brief' WHEN contains(text, '@') THEN 'contact' WHEN (length(text) - length(replace(text, chr(10), ''))) * 40 > tokens THEN 'lines' ELSE 'prose' END AS topic FROM d0)",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for k, p in TEMPER.items():
        q.append(f"g_{k} AS (SELECT {k}, pow(sum(t), {p}) / sum(pow(sum(t), {p})) OVER () AS g FROM c GROUP BY {k})")
    q.append("w0 AS (SELECT *, t AS w FROM c)")
    n = 0
    for _ in range(ROUNDS):
        for k in TEMPER:
            q.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, t, w * g / sum(w) OVER (PARTITION BY {k}) AS w FROM w{n} JOIN g_{k} USING ({k}))")
            n += 1
    q.append(f"v AS MATERIALIZED (SELECT source, lang, topic, t, (w / sum(w) OVER ()) / (t / sum(t) OVER ()) AS weight, sum(t) OVER () AS a FROM w{n})")
    q.append(f"s0 AS (SELECT CAST({budget} AS DOUBLE) AS s)")
    for i in range(CALIBRATIONS):
        q.append(f"s{i + 1} AS MATERIALIZED (SELECT coalesce(greatest(any_value(s), (any_value(a) * {budget} - sum(CASE WHEN s * weight >= 1 THEN t ELSE 0 END)) / sum(CASE WHEN s * weight < 1 THEN t * weight END)), any_value(s)) AS s FROM v, s{i})")
    q.append(f"p AS (SELECT source, lang, topic, round(weight, 6) AS weight, round(least(1.0, s * weight), 6) AS probability FROM v, s{CALIBRATIONS})")
    return "WITH " + ",\n".join(q) + f"""
SELECT doc_id, tokens, substr(topic, 2) AS topic, coalesce(weight, 1.0) AS weight, coalesce(probability, {budget}) AS probability,
  CAST(CAST('0x' || substr(md5('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < coalesce(probability, {budget}) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


ORACLE = oracle()
