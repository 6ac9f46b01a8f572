"""Replay of an event-log folder as a stream; the state equals the batch replay of the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import last_state

KEEP, REMOVE = ("discovered", "updated"), ("removed",)


def stream(spark: SparkSession, path: str, ddl: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest(batch: DataFrame) -> DataFrame:
    """The last relevant event of each object in a batch, removals included."""
    seen = batch.where(F.col("event_type").isin(*KEEP, *REMOVE) & ((F.col("event_type") == "removed") | F.col("payload_value").isNotNull()))
    return seen.groupBy("object_id").agg(F.max_by(F.struct("seq", "event_type", "payload_value"), "seq").alias("e")).select("object_id", "e.*")


def run(spark: SparkSession, source: str, ddl: str, state: str, checkpoint: str) -> None:
    """Folds all files there are into state folders, one a batch; a batch that is tried again rewrites its own folder only."""

    def fold(batch: DataFrame, epoch: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    q = stream(spark, source, ddl).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def live(spark: SparkSession, state: str) -> DataFrame:
    """Live objects of all epochs so far."""
    return last_state(spark.read.parquet(state).drop("epoch"), "object_id", "seq", KEEP, REMOVE)
