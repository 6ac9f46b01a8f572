"""Verification rules. A rule is a frame of violations (id); a report is one row a rule: status, count and an example."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lineage as L


def rule(name: str, violations: DataFrame, id_col: str, level: str = "fail") -> DataFrame:
    """(name, status, n, example) of a rule: ok without violations, else its level; the smallest id is the example."""
    n = violations.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(id_col).cast("string")).alias("example"))
    return n.select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "ok").otherwise(level).alias("status"), "n", "example")


def report(rules: Iterable[DataFrame]) -> DataFrame:
    """All rules as checks (id, name, status, severity, n, example), numbered in the order given."""
    out = None
    for k, r in enumerate(rules, 1):
        part = r.select(S.check_slug(F.lit(k), F.col("name")).alias("id"), "name", S.status_name(F.col("status")).alias("status"), S.severity(F.col("status")).alias("severity"), "n", "example")
        out = part if out is None else out.unionByName(part)
    return out


def core(chunks: DataFrame, leaves: DataFrame, subset: bool = False) -> list[DataFrame]:
    """Rules of the chunk store. On a subset, what needs all chunks warns only."""
    level = "warn" if subset else "fail"
    c = chunks.select("sequence", "chunk_id", "source_offset", "source_length", "plaintext_sha256", "stored_sha256", "compression", "stored_length")
    # Neighbours by sequence: a join with the next row, so that nothing is sorted in one task.
    nxt = c.select((F.col("sequence") - 1).alias("sequence"), F.col("source_offset").alias("next_offset"))
    gaps = c.join(nxt, "sequence").where(F.col("next_offset") != F.col("source_offset") + F.col("source_length"))
    both = c.select("sequence", F.col("plaintext_sha256").alias("a")).join(leaves.select("sequence", F.col("plaintext_sha256").alias("b")), "sequence", "full_outer")
    return [
        rule("mapping gaps", gaps, "sequence", level),
        rule("chunk id is the plaintext hash", c.where(S.bare(F.col("chunk_id")) != F.col("plaintext_sha256")), "sequence"),
        rule("stored equals plain without compression", c.where("compression = 'none' AND (stored_sha256 <> plaintext_sha256 OR stored_length <> source_length)"), "sequence"),
        rule("unknown compression", c.where("compression NOT IN ('none', 'zstd')"), "sequence"),
        rule("leaves match mapping", both.where(~F.col("a").eqNullSafe(F.col("b"))), "sequence", level),
        rule("sequence repeats", c.groupBy("sequence").count().where("count > 1"), "sequence"),
    ]


def provenance(log: DataFrame, first_only: bool = True) -> DataFrame:
    """(line_no, problem) of a custody log: empty or repeated ids, missing fields, falling numbers; by default the first line only."""
    n = F.regexp_extract("event_id", "^evt-([0-9]+)$", 1).try_cast("long")
    seen = log.withColumn("number", n)
    repeats = seen.groupBy("event_id").agg(F.min("line_no").alias("first"))
    prev = seen.select((F.col("line_no") + 1).alias("line_no"), F.col("number").alias("before"))
    j = seen.join(repeats, "event_id", "left").join(prev, "line_no", "left")
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = (
        F.when(empty("event_id"), "empty event_id").when(F.col("line_no") > F.col("first"), "repeated event_id").when(empty("actor"), "actor").when(empty("action"), "action")
        .when(empty("tool_name") | empty("tool_version"), "tool").when(F.col("number") < F.col("before"), "number falls")
    )
    bad = j.select("line_no", problem.alias("problem")).where("problem IS NOT NULL")
    return bad if not first_only else bad.groupBy().agg(F.min_by(F.struct("line_no", "problem"), "line_no").alias("v")).where("v IS NOT NULL").select("v.*")


def missing_keys(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(line_no, problem) of JSON lines: the first absent key of each record; a bad line ends the file. Empty strings pass."""
    parsed = lines.select("line_no", F.try_parse_json("value").alias("v"))
    absent = F.coalesce(*[F.when(F.try_variant_get("v", f"$.{k}", "variant").isNull(), F.lit(f"missing {k}")) for k in keys])
    bad = parsed.select("line_no", F.when(F.col("v").isNull(), "bad JSON").otherwise(absent).alias("problem"))
    first_bad = bad.agg(F.coalesce(F.min(F.when(F.col("problem") == "bad JSON", F.col("line_no"))), F.lit(1 << 62)).alias("stop"))
    return bad.join(F.broadcast(first_bad), F.col("line_no") <= F.col("stop")).where("problem IS NOT NULL").select("line_no", "problem")


# Hash states an object may have.
HASH_STATUS = ("verified", "deferred", "computed", "not_applicable", "unavailable")


def references(rows: DataFrame, edges: DataFrame, derivations: DataFrame) -> list[DataFrame]:
    return [
        rule("edge parents exist", L.missing_endpoint(edges, rows, "parent_object_id"), "edge_id"),
        rule("edge children exist", L.missing_endpoint(edges, rows, "child_object_id"), "edge_id"),
        rule("derivation parents exist", L.missing_endpoint(derivations, rows, "parent_object_id"), "derivation_id"),
        rule("derivation children exist", L.missing_endpoint(derivations, rows, "child_object_id"), "derivation_id"),
    ]


def objects(rows: DataFrame, edges: DataFrame, derivations: DataFrame) -> list[DataFrame]:
    return [
        rule("object ids are unique", rows.groupBy("object_id").count().where("count > 1"), "object_id"),
        rule("hash status is known", rows.where(F.col("content_hash_status").isNotNull() & ~F.col("content_hash_status").isin(*HASH_STATUS)), "object_id"),
        rule("files have a parent", L.without_parent(rows, edges, "file", "contains"), "object_id"),
        *references(rows, edges, derivations),
    ]


def lineage(rows: DataFrame, edges: DataFrame, derivations: DataFrame) -> list[DataFrame]:
    hashes = L.derivation_hashes(derivations, rows)
    return [
        *references(rows, edges, derivations),
        rule("derivations have an edge", L.derivations_without_edge(derivations, edges), "derivation_id"),
        rule("derivation hashes", hashes.where("result = 'fail'"), "derivation_id"),
        rule("derivation hashes are given", hashes.where("result = 'warn'"), "derivation_id", "warn"),
    ]


def parallel(issues: DataFrame) -> list[DataFrame]:
    return [rule(k.replace("_", " "), issues.where(F.col("kind") == k), "id") for k in ("missing_shard_manifest", "missing_result", "scope_hash_mismatch", "artifact_unreadable", "artifact_hash_mismatch", "duplicate_input")]


def collection(roots: DataFrame, rows: DataFrame, limitations: int = 0) -> list[DataFrame]:
    """Rules of a file collection: declared roots, limitations (a warning), root objects, repeated ids."""
    spark = roots.sparkSession
    held = rows.select(F.col("object_id").alias("root_object")).distinct()
    return [
        rule("collection has roots", spark.range(1).where(F.lit(0) == roots.count()), "id"),
        rule("limitations", spark.range(limitations), "id", "warn"),
        rule("root objects are indexed", roots.join(held, "root_object", "left_anti"), "root_id"),
        rule("object ids are unique", rows.groupBy("object_id").count().where("count > 1"), "object_id"),
    ]


def case(roots: DataFrame, rows: DataFrame, profile: str = "registry") -> list[DataFrame]:
    """Rules of a case: registry rules always; with any other profile the roots, with `full` the objects too."""
    out = [
        rule("root ids are unique", roots.groupBy("root_id").count().where("count > 1"), "root_id"),
        rule("root reference is known", roots.where("ref_type NOT IN ('embedded', 'relative', 'absolute', 'uri')"), "root_id"),
    ]
    if profile != "registry":
        out += [rule("roots are attached", roots.where("status <> 'active'"), "root_id", "warn"), rule("roots are online", roots.where("availability <> 'online'"), "root_id", "warn")]
    if profile == "full":
        out.append(rule("objects have a known root", rows.join(roots.select("root_id"), "root_id", "left_anti"), "object_id"))
    return out


def documents(rows: DataFrame, rules: list[tuple[str, str, str | tuple[str, ...]]]) -> DataFrame:
    """(row_id, path, message) of JSON texts (row_id, value) against (path, kind, argument): required, pattern or enum."""
    v = F.try_parse_json("value")
    tests = []
    for path, kind, arg in rules:
        text = F.try_variant_get(v, f"$.{path}", "string")
        absent = F.try_variant_get(v, f"$.{path}", "variant").isNull()
        bad = absent if kind == "required" else F.coalesce(~text.rlike(arg), F.lit(False)) if kind == "pattern" else F.coalesce(~text.isin(*arg), F.lit(False))
        tests.append(F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(kind).alias("message"))))
    return rows.select("row_id", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("e")).select("row_id", "e.*")


# Files that a conformance profile asks for.
PROFILES = {
    "reader": ("manifest.json", "acquisition.json", "indexes/physical_to_chunk.parquet"),
    "analysis": ("manifest.json", "analysis"),
    "indexer": ("manifest.json", "indexes/partitions/partition_table.json", "indexes/objects/object_index.parquet"),
    "acquisition": ("manifest.json", "acquisition.json", "integrity/leaves.parquet", "provenance/chain_of_custody.jsonl"),
}


def conformance(spark, files: DataFrame, profile: str) -> DataFrame:
    """(path, present): what a profile asks for against the container's files (path)."""
    want = spark.createDataFrame([(p,) for p in PROFILES[profile]], "path string")
    tops = files.select("path").union(files.select(F.substring_index("path", "/", 1))).distinct().withColumn("present", F.lit(True))
    return want.join(tops, "path", "left").select("path", F.coalesce("present", F.lit(False)).alias("present"))
