"""Referential rules of the object graph, neighbours and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_endpoint(links: DataFrame, objects: DataFrame, end: str) -> DataFrame:
    """Links whose `end` column names no object."""
    known = objects.select(F.col("object_id").alias(end))
    return links.join(known, end, "left_anti")


def derivations_without_edge(derivations: DataFrame, edges: DataFrame) -> DataFrame:
    return derivations.join(edges.select("parent_object_id", "child_object_id"), ["parent_object_id", "child_object_id"], "left_anti")


def derivation_hashes(derivations: DataFrame, objects: DataFrame) -> DataFrame:
    """(derivation_id, side, result): ok, fail where a hash differs from the object's, warn where either is missing."""
    known = objects.select(F.col("object_id"), F.col("sha256").alias("actual"))
    sides = derivations.select("derivation_id", F.explode(F.array(
        F.struct(F.lit("input").alias("side"), F.col("parent_object_id").alias("object_id"), F.col("input_sha256").alias("given")),
        F.struct(F.lit("output").alias("side"), F.col("child_object_id").alias("object_id"), F.col("output_sha256").alias("given")),
    )).alias("s")).select("derivation_id", "s.*")
    both = sides.join(known, "object_id", "left")
    result = F.when(F.col("given").isNull() | F.col("actual").isNull(), "warn").when(F.col("given") == F.col("actual"), "ok").otherwise("fail")
    return both.select("derivation_id", "side", result.alias("result"))


def without_parent(objects: DataFrame, edges: DataFrame, object_type: str, relation: str) -> DataFrame:
    """Objects of a type that no edge of a relation points at."""
    held = edges.where(F.col("relation_type") == relation).select(F.col("child_object_id").alias("object_id"))
    return objects.where(F.col("object_type") == object_type).join(held, "object_id", "left_anti")


def roots(objects: DataFrame, edges: DataFrame) -> DataFrame:
    return objects.join(edges.select(F.col("child_object_id").alias("object_id")), "object_id", "left_anti")


def leaves(objects: DataFrame, edges: DataFrame) -> DataFrame:
    return objects.join(edges.select(F.col("parent_object_id").alias("object_id")), "object_id", "left_anti")


def neighbours(objects: DataFrame, edges: DataFrame, pointers: DataFrame, node: str, up: bool) -> DataFrame:
    """Objects next to a node, by edges first and then by parent pointers (object_id, parent_id); each once."""
    here, there = ("child_object_id", "parent_object_id") if up else ("parent_object_id", "child_object_id")
    p_here, p_there = ("object_id", "parent_id") if up else ("parent_id", "object_id")
    by_edge = edges.where(F.col(here) == node).select(F.col(there).alias("object_id"), F.lit(0).alias("via"))
    by_pointer = pointers.where(F.col(p_here) == node).select(F.col(p_there).alias("object_id"), F.lit(1).alias("via"))
    first = by_edge.unionByName(by_pointer).groupBy("object_id").agg(F.min("via").alias("via"))
    return first.join(objects, "object_id")


def parents_csv(edges: DataFrame) -> DataFrame:
    """(child, parents): parents of a child in edge order, with bars between."""
    return edges.groupBy("child_object_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "parent_object_id"))), lambda x: x["parent_object_id"]), "|").alias("parents"))


def root_lookup(wanted: DataFrame, objects: DataFrame, roots_: DataFrame) -> DataFrame:
    """(object_id, root_id, outcome): not_found, ambiguous, no_root, missing_root, inactive_root or ok."""
    seen = objects.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.min("root_id").alias("root_id"))
    j = wanted.join(seen, "object_id", "left").join(roots_.select("root_id", F.col("status").alias("root_status")), "root_id", "left")
    out = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("root_id").isNull(), "no_root").when(F.col("root_status").isNull(), "missing_root").when(F.col("root_status") != "active", "inactive_root").otherwise("ok")
    return j.select("object_id", "root_id", out.alias("outcome"))
