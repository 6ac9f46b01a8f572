"""Analysis scopes: which objects a job takes, their numbers and their hash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import extension_scope


@dataclass(frozen=True)
class Selectors:
    """Empty lists and None restrict nothing."""

    object_ids: tuple[str, ...] = ()
    object_types: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    parser_status: tuple[str, ...] = ()
    max_size: int | None = None
    min_size: int | None = None


# Object types that keep their name as input type.
INPUT_TYPES = ("evidence_file", "derived_object", "artifact", "file")


def input_type(object_type: Column) -> Column:
    return F.when(object_type.isin(*INPUT_TYPES), object_type).otherwise("object")


def select(objects: DataFrame, s: Selectors) -> DataFrame:
    """Objects that a scope admits; a missing size counts as 0, a missing media type as empty."""
    size = F.coalesce("size_bytes", F.lit(0))
    tests = [
        (s.object_ids, F.col("object_id").isin(*s.object_ids)),
        (s.object_types, F.col("object_type").isin(*s.object_types)),
        (s.extensions, extension_scope(F.col("name"), F.col("logical_path")).isin(*[e.lstrip(".").lower() for e in s.extensions])),
        (s.media_types, F.coalesce("media_type", F.lit("")).isin(*s.media_types)),
        (s.parser_status, F.col("parser_status").isin(*s.parser_status)),
    ]
    for given, test in tests:
        if given:
            objects = objects.where(F.coalesce(test, F.lit(False)))
    if s.max_size is not None:
        objects = objects.where(size <= s.max_size)
    return objects if s.min_size is None else objects.where(size >= s.min_size)


def exclude(objects: DataFrame, labels: DataFrame | None = None, names: tuple[str, ...] = (), sets: DataFrame | None = None, set_ids: tuple[str, ...] = ()) -> DataFrame:
    """Without objects that carry an excluded label (target_id, label) or belong to an excluded set (set_id, object_id)."""
    if labels is not None and names:
        objects = objects.join(labels.where(F.col("label").isin(*names)).select(F.col("target_id").alias("object_id")), "object_id", "left_anti")
    if sets is not None and set_ids:
        objects = objects.join(sets.where(F.col("set_id").isin(*set_ids)).select("object_id"), "object_id", "left_anti")
    return objects


def include_sets(objects: DataFrame, sets: DataFrame, set_ids: tuple[str, ...]) -> DataFrame:
    """Only members of any of the sets."""
    return objects.join(sets.where(F.col("set_id").isin(*set_ids)).select("object_id"), "object_id", "left_semi")


def numbered(objects: DataFrame) -> DataFrame:
    """Objects with position (from 0, by object_id) and input_id. Range-sorted parts are counted, then ranked on their own."""
    spark = objects.sparkSession
    from ..sources.store import shared_dir, stored

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(objects.repartitionByRange(parts, "object_id").withColumn("_part", F.spark_partition_id()), shared_dir(spark))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("object_id")) - 1
    out = ranged.withColumn("_rank", rank).join(offsets, "_part").withColumn("position", (F.col("_rank") + F.col("_before")).cast("long"))
    return out.withColumn("input_id", F.format_string("input-%06d", F.col("position") + 1)).drop("_part", "_rank", "_before")


def resolve(objects: DataFrame, s: Selectors) -> DataFrame:
    """(position, input_id, object_id, input_type, logical_path, size_bytes, sha256) of a scope's inputs."""
    rows = numbered(select(objects, s))
    return rows.select("position", "input_id", "object_id", input_type(F.col("object_type")).alias("input_type"), "logical_path", "size_bytes", "sha256")


def scope_hash(inputs: DataFrame) -> DataFrame:
    """One row: `sha256:` and the digest of the ids in order with newlines between. Sequential by definition: the sorted ids pass the
    driver a partition at a time, none are kept."""
    h, n, between = hashlib.sha256(), 0, b""
    for row in inputs.select("object_id").orderBy("object_id").toLocalIterator(prefetchPartitions=True):
        n += 1
        if row[0] is not None:
            h.update(between + row[0].encode())
            between = b"\n"
    return inputs.sparkSession.createDataFrame([(n, f"sha256:{h.hexdigest()}")], "inputs long, scope_hash string")


def resolve_sdk(objects: DataFrame, object_types: tuple[str, ...] = (), extensions: tuple[str, ...] = (), exclude_labels: tuple[str, ...] = (), max_size: int | None = None) -> DataFrame:
    """The other dialect: types and extensions without case, labels in the rows themselves (array labels)."""
    if object_types:
        objects = objects.where(F.lower("object_type").isin(*[t.lower() for t in object_types]))
    if extensions:
        objects = objects.where(F.coalesce(extension_scope(F.col("name"), F.col("logical_path")).isin(*[e.lstrip(".").lower() for e in extensions]), F.lit(False)))
    if exclude_labels:
        objects = objects.where(~F.arrays_overlap(F.transform("labels", F.lower), F.array(*[F.lit(x.lower()) for x in exclude_labels])))
    return objects if max_size is None else objects.where(F.coalesce("size_bytes", F.lit(0)) <= max_size)
