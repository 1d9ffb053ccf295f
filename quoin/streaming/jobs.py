"""Job states as a stream of events: the durable, resumable form of batch records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: States of a tile in order; a submitted tile without a task is never sent again.
STATES = ("pending", "submitting", "waiting", "completed", "error")


def current(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Latest state of each key of a stream (at, seq, state, task), as an update-mode aggregate."""
    return events.withWatermark("at", late).groupBy(*key).agg(F.max_by(F.struct("state", "task", "at"), F.struct("seq", "at")).alias("s")).select(*key, "s.*")


def resumable(states: DataFrame) -> DataFrame:
    """What to do with each tile on resume: post, poll, keep, or review (sent, but no task is known)."""
    act = F.when(F.col("state") == "completed", "keep").when(F.col("state") == "pending", "post").when(F.col("task").isNotNull(), "poll").otherwise("review")
    return states.withColumn("action", act)


def run_status(states: DataFrame, run: str) -> DataFrame:
    """Status of a batch that stops at its first failure."""
    out = states.groupBy(run).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "completed").alias("done"), F.count_if(F.col("state") == "error").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("n"), "completed").otherwise("running"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of current states as one Parquet folder, overwritten if a batch is repeated: exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
