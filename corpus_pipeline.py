"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

1. language_id: texts in which no language is recognised go, as do those of which less than LEAST_COVERAGE of the n-grams
   belong to it; null and empty texts go with them.
2. near_duplicates: of each group linked by five-word shingles at a similarity of 0.8 or more, one row stays: the one with
   the smallest doc_id and, of rows that share it, the one whose text has the least hash (then the least row as JSON). Rows without words link with
   nothing and stay, as do rows without doc_id.
3. repeated_passages: words in repeated windows of 35 words go; documents of which nothing is left go.
4. mixture: documents are drawn by probabilities raked to source, language and topic targets. Null sources and languages
   are values of their own; rows that share a doc_id share one draw.
5. tokens: SentencePiece ids of what is left.

All stages but the last return the columns of their input, whatever their names; texts of any length are taken whole;
repeated rows are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import op1_substring, op4_language, op5_jaccard, op7_mixing, op10_sentencepiece
from quoin.llm.shared import fresh, scratch, text_key
from quoin.runtime import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_COVERAGE = 0.2
CACHE = 100_000
"""Sections that the encoder keeps: fewer than when it runs alone, as workers serve all stages."""


def _columns(docs: DataFrame) -> list[Column]:
    """All columns by their names, which may hold dots."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(ship(spark), docs, sf_dir)

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = docs.where(op4_language.learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = op4_language.fit(train, "text", "lang")
    names = tuple(fresh(docs, "lang_pred", "lang_score", "lang_coverage"))
    told = op4_language.predict(docs, model, "text", tuple(docs.columns), names)
    return told.where((F.col(names[0]) != "und") & (F.col(names[2]) >= LEAST_COVERAGE)).select(*_columns(docs))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op5_jaccard.joined(docs, op5_jaccard.Join(5, 80), with_text_key=True).where("group IS NOT NULL AND doc_id IS NOT NULL")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("first"))
    names = fresh(docs, "first_id", "first_h1", "first_h2", "row")
    key = [F.col("doc_id").cast("long"), *text_key(F.col("text"))]
    keyed = docs.withColumns(dict(zip(names, key)))
    stays = first.select(*[F.col(f"first.{c}").alias(n) for c, n in zip(("doc_id", "h1", "h2"), names)])
    rows = keyed.join(stays, names[:3], "left_semi").select(*names[:3], F.struct(*_columns(docs)).alias(names[3]))
    one = rows.groupBy(*names[:3]).agg(F.min_by(names[3], F.to_json(names[3])).alias(names[3]))  # of rows that repeat it
    alone = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return one.select(*[F.col(names[3])[c].alias(c) for c in docs.columns]).union(docs.where(alone))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_words, n_removed, text = "n_words", "n_removed", "kept"
    found = op1_substring.remove_repeats(docs.select(F.struct(*_columns(docs)).alias("doc"), F.col("text")), "text", with_text=True)
    changed = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.coalesce(text, F.col("doc.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    left = found.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    return left.select(*[changed[c].alias(c) for c in docs.columns])


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n, topic, weight, chance = fresh(docs, "n_tokens", "topic", "weight", "probability")
    counted = docs.withColumn(n, op7_mixing.tokens(F.col("text")))
    counted = counted.withColumn(topic, F.when(F.col("text").isNull(), "brief").otherwise(op7_mixing.topic(F.col("text"), F.col(n))))
    dims = {topic if d == "topic" else d: p for d, p in op7_mixing.TEMPER.items()}
    out = op7_mixing.weighted(counted, dims, n, names=(weight, chance))
    return out.where(op7_mixing.drawn(F.col("doc_id"), F.col(chance))).select(*_columns(docs))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_sentencepiece.encode_documents(docs, op10_sentencepiece.default_model(), keep=("doc_id", "lang", "source"), with_ids=True, cache=CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express language identification; tests/llm hold run() against a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
