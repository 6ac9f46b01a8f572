"""A case's registry of evidence roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registry_problems(roots: DataFrame, case_id: str, declared_case: str, declared_count: int) -> DataFrame:
    """(problem, id): other case, wrong count, repeated roots."""
    spark = roots.sparkSession
    head = [("case_id", declared_case)] if case_id != declared_case else []
    n = roots.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != declared_count).select(F.lit("root_count").alias("problem"), F.col("n").cast("string").alias("id"))
    twice = roots.groupBy("root_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_root").alias("problem"), F.col("root_id").alias("id"))
    return spark.createDataFrame(head, "problem string, id string").union(n).union(twice)


def attach(roots: DataFrame, root_id: str, **values) -> DataFrame:
    """roots with one more; ValueError if the id is taken."""
    if roots.where(F.col("root_id") == root_id).limit(1).count():
        raise ValueError(f"{root_id} is attached already")
    row = roots.sparkSession.createDataFrame([tuple({"root_id": root_id, "status": "active", "availability": "online"}.get(c, values.get(c)) if c not in values else values[c] for c in roots.columns)], roots.schema)
    return roots.unionByName(row)


def detach(roots: DataFrame, root_id: str) -> DataFrame:
    """roots with one marked as detached; ValueError if there is none."""
    if not roots.where(F.col("root_id") == root_id).limit(1).count():
        raise ValueError(f"{root_id} is unknown")
    return roots.withColumn("status", F.when(F.col("root_id") == root_id, "detached").otherwise(F.col("status")))


def location(base: str) -> Column:
    """Where a root (ref_type, name) lies; null for what cannot be opened."""
    t, n = F.col("ref_type"), F.col("name")
    return F.when(t == "embedded", F.lit(base)).when(t == "relative", F.concat(F.lit(base + "/"), n)).when(t == "absolute", F.concat(F.lit("/"), n)).when((t == "uri") & ~n.startswith("s3://"), n)


def index_status(has_index: Column) -> Column:
    """What a root's objects are in the case's index, tested in this order."""
    return F.when(F.col("status") != "active", "skipped_inactive").when(F.col("availability") != "online", "skipped_unavailable").when(~has_index, "skipped_missing_object_index").otherwise("included")


def event_id(number: Column) -> Column:
    return F.format_string("case-evt-%06d", number)


def inferred_root() -> tuple[Column, Column]:
    """(root_id, root_type) of a container (roots array<struct<root_id,root_type>>, acquisition_mode)."""
    first = F.try_element_at("roots", F.lit(1))
    return F.coalesce(first["root_id"], F.lit("root-0")), F.coalesce(first["root_type"], F.coalesce("acquisition_mode", F.lit("block_image")))
