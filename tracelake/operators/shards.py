"""Shards of a job: assignment, plans, coverage, status and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("range", "round_robin", "hash_modulo")


def shard_of(strategy: str, shards: int) -> Column:
    """Shard of an input (position, object_id). Range and round-robin both deal positions in turn."""
    if shards <= 0:
        raise ValueError("a plan needs one shard at least")
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    if strategy == "hash_modulo":
        return F.conv(F.substring(F.sha2("object_id", 256), 1, 2), 16, 10).cast("long") % shards
    return F.col("position") % shards


def shard_name(job: str, index: Column) -> Column:
    return F.format_string(f"{job}-shard-%02d", index)


def manifests(inputs: DataFrame, job: str, strategy: str, shards: int) -> DataFrame:
    """(shard_index, shard_id, n, ids array) of all shards; empty ones stay."""
    spark = inputs.sparkSession
    dealt = inputs.withColumn("shard_index", shard_of(strategy, shards)).groupBy("shard_index").agg(F.array_sort(F.collect_list(F.struct("position", "object_id"))).alias("l"))
    every = spark.range(shards).select(F.col("id").alias("shard_index"))
    ids = F.coalesce(F.transform("l", lambda x: x["object_id"]), F.array().cast("array<string>"))
    return every.join(dealt, "shard_index", "left").select("shard_index", shard_name(job, F.col("shard_index")).alias("shard_id"), F.size(ids).cast("long").alias("n"), ids.alias("ids"))


def coverage(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row of sums over the shards' statistics, with the inputs in scope and those in no shard."""
    sums = results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("assigned", "processed", "success", "error", "skipped")])
    return inputs.agg(F.count(F.lit(1)).alias("in_scope")).join(F.broadcast(sums), F.lit(True))  # one row with one row


def job_status(plan: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, completed, failed, status): a planned shard without result counts as failed."""
    j = plan.join(results.select("shard_id", F.col("status").alias("s")), "shard_id", "left")
    good = F.coalesce(F.col("s") == "completed", F.lit(False))
    n = j.groupBy("job_id").agg(F.count_if(good).alias("completed"), F.count_if(~good).alias("failed"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("completed") == 0, "failed").otherwise("partial"))


def duplicate_inputs(members: DataFrame) -> DataFrame:
    """(object_id, shards): inputs in more than one shard, with the shards' ids in order."""
    d = members.groupBy("object_id").agg(F.array_sort(F.collect_set("shard_id")).alias("s"))
    return d.where(F.size("s") > 1).select("object_id", F.array_join("s", ",").alias("shards"))


def issues(plan: DataFrame, found: DataFrame, results: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """(kind, id): planned shards (shard_id) without manifest or result, wrong scope hashes, bad artifacts, duplicates."""
    kind = lambda df, name, col="shard_id": df.select(F.lit(name).alias("kind"), F.col(col).alias("id"))
    out = kind(plan.join(found, "shard_id", "left_anti"), "missing_shard_manifest")
    out = out.union(kind(plan.join(results, "shard_id", "left_anti"), "missing_result"))
    out = out.union(kind(results.where(F.col("scope_hash") != scope), "scope_hash_mismatch"))
    out = out.union(kind(results.where(F.col("artifact_actual").isNull()), "artifact_unreadable"))
    out = out.union(kind(results.where(F.col("artifact_actual") != F.col("artifact_sha256")), "artifact_hash_mismatch"))
    return out.union(kind(duplicate_inputs(members), "duplicate_input", "object_id"))


def statistics(outputs: DataFrame) -> DataFrame:
    """Per shard: processed = results + errors + skips, from rows (shard_id, outcome)."""
    o = F.col("outcome")
    return outputs.groupBy("shard_id").agg(F.count_if(o.isin("result", "error", "skip")).alias("processed"), F.count_if(o == "result").alias("success"), F.count_if(o == "error").alias("error"), F.count_if(o == "skip").alias("skipped"))
