"""Queries of scopes, shards, jobs and materialised objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import scope as C
from ..operators import shards as H
from ..registry import RELATIONS, query
from ..sources import fixtures as X
from .q_joins import file_chunks

SCOPE = C.Selectors(object_types=("evidence_file", "file"), extensions=(".EN", "..de"), parser_status=("ok",), max_size=20_000, min_size=50)

_EXT = "CASE WHEN name IS NOT NULL THEN lower(split_part(name, '.', 2)) ELSE split_part(logical_path, '.', -1) END"
RELATIONS["fx_scope"] = f"""
SELECT row_number() OVER (ORDER BY object_id) - 1 AS position, * FROM fx_doc_objects
WHERE object_type IN ('evidence_file', 'file') AND {_EXT} IN ('en', 'de') AND parser_status = 'ok' AND coalesce(size_bytes, 0) BETWEEN 50 AND 20000"""


def scope_inputs(spark, sf):
    return C.resolve(X.doc_objects(spark, sf), SCOPE)


@query("scope_resolve", "SELECT position, 'input-' || lpad(CAST(position + 1 AS VARCHAR), 6, '0') AS input_id, object_id FROM fx_scope")
def scope_resolve(spark, sf):
    return scope_inputs(spark, sf).select("position", "input_id", "object_id")


@query("scope_project", "SELECT object_id, CASE WHEN object_type IN ('evidence_file', 'derived_object', 'artifact', 'file') THEN object_type ELSE 'object' END AS input_type, logical_path, size_bytes, sha256 FROM fx_doc_objects")
def scope_project(spark, sf):
    return X.doc_objects(spark, sf).select("object_id", C.input_type(F.col("object_type")).alias("input_type"), "logical_path", "size_bytes", "sha256")


def _labelled(spark, sf):
    labels = X.label_events(spark, sf).groupBy(F.col("target_id").alias("object_id")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return X.doc_objects(spark, sf).join(labels, "object_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


@query("scope_resolve_sdk", f"SELECT object_id FROM fx_doc_objects WHERE object_type = 'email' AND {_EXT} IN ('en', 'fr') AND coalesce(size_bytes, 0) <= 5000 AND object_id NOT IN (SELECT target_id FROM fx_label_events WHERE label = 'restricted')")
def scope_resolve_sdk(spark, sf):
    return C.resolve_sdk(_labelled(spark, sf), ("EMAIL",), (".En", "FR"), ("Restricted",), 5000).select("object_id")


RELATIONS["fx_sets"] = "SELECT 'set-' || (doc_id % 5) AS set_id, CASE doc_id % 3 WHEN 0 THEN 'working' WHEN 1 THEN 'release' ELSE 'exclusion' END AS set_type, object_id FROM fx_doc_objects WHERE doc_id % 4 = 0"


def set_members(spark, sf):
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "working").when(d % 3 == 1, "release").otherwise("exclusion")
    return X.doc_objects(spark, sf).where("doc_id % 4 = 0").select(F.concat(F.lit("set-"), (d % 5).cast("string")).alias("set_id"), kind.alias("set_type"), "object_id")


@query("scope_exclude_labels_sets", "SELECT object_id FROM fx_doc_objects WHERE object_id NOT IN (SELECT target_id FROM fx_label_events WHERE label IN ('restricted', 'low_quality')) AND object_id NOT IN (SELECT object_id FROM fx_sets WHERE set_id = 'set-2')")
def scope_exclude_labels_sets(spark, sf):
    return C.exclude(X.doc_objects(spark, sf), X.label_events(spark, sf), ("restricted", "low_quality"), set_members(spark, sf), ("set-2",)).select("object_id")


@query("scope_include_sets", "SELECT object_id FROM fx_doc_objects WHERE object_id IN (SELECT object_id FROM fx_sets WHERE set_id IN ('set-1', 'set-3'))")
def scope_include_sets(spark, sf):
    return C.include_sets(X.doc_objects(spark, sf), set_members(spark, sf), ("set-1", "set-3")).select("object_id")


@query("agg_scope_hash", "SELECT count(*) AS inputs, 'sha256:' || sha256(string_agg(object_id, chr(10) ORDER BY object_id)) AS scope_hash FROM fx_scope")
def agg_scope_hash(spark, sf):
    return C.scope_hash(scope_inputs(spark, sf))


@query("list_objects", "SELECT object_id, object_type FROM fx_objects WHERE object_type = 'container' ORDER BY object_id LIMIT 25 OFFSET 10")
def list_objects(spark, sf):
    return X.objects(spark, sf).where("object_type = 'container'").select("object_id", "object_type").orderBy("object_id").offset(10).limit(25)


@query("get_object", "SELECT object_id, object_type, size_bytes, root_id FROM fx_objects WHERE object_id = 'o7'")
def get_object(spark, sf):
    return X.objects(spark, sf).where("object_id = 'o7'").select("object_id", "object_type", "size_bytes", "root_id").limit(1)


@query("get_set", "SELECT set_id, arg_min(set_type, CASE set_type WHEN 'working' THEN 0 WHEN 'release' THEN 1 ELSE 2 END) AS set_type FROM fx_sets WHERE set_id = 'set-3' GROUP BY set_id")
def get_set(spark, sf):
    rank = F.when(F.col("set_type") == "working", 0).when(F.col("set_type") == "release", 1).otherwise(2)
    return set_members(spark, sf).where("set_id = 'set-3'").groupBy("set_id").agg(F.min_by("set_type", rank).alias("set_type"))


@query("get_scope", "SELECT conv_id AS scope_id, count(*) AS turns FROM conversations WHERE conv_id = 7 GROUP BY conv_id")
def get_scope(spark, sf):
    return X.read(spark, sf, "conversations").where("conv_id = 7").groupBy(F.col("conv_id").alias("scope_id")).agg(F.count(F.lit(1)).alias("turns"))


@query("decisions_for_target", "SELECT label_event_id, label FROM fx_label_events WHERE target_id = (SELECT max(target_id) FROM fx_label_events)")
def decisions_for_target(spark, sf):
    target = X.label_events(spark, sf).agg(F.max("target_id")).first()[0]
    return X.label_events(spark, sf).where(F.col("target_id") == target).select("label_event_id", "label")


def chunks_by_ref(chunks, refs):
    """Chunks named by a list of sequence numbers or chunk ids."""
    numbers = [int(r) for r in refs if r.isdigit()]
    return chunks.where(F.col("chunk_id").isin(*refs) | F.col("sequence").isin(*numbers))


@query("chunk_subset", "SELECT sequence, chunk_id FROM fx_chunk_map WHERE sequence IN (1, 5, 9) OR chunk_id = 'sha256:' || (SELECT sha256(text) FROM documents WHERE doc_id = 20)")
def chunk_subset(spark, sf):
    wanted = X.read(spark, sf, "documents").where("doc_id = 20").select(S.tagged(F.sha2("text", 256))).first()[0]
    return chunks_by_ref(X.chunk_map(spark, sf), ["1", "5", "9", wanted]).select("sequence", "chunk_id")


@query("chunk_by_ref", "SELECT min(sequence) AS sequence, arg_min(source_offset, sequence) AS source_offset FROM fx_chunk_map WHERE chunk_id = 'sha256:' || (SELECT sha256(text) FROM documents WHERE doc_id = 20)")
def chunk_by_ref(spark, sf):
    wanted = X.read(spark, sf, "documents").where("doc_id = 20").select(S.tagged(F.sha2("text", 256))).first()[0]
    return chunks_by_ref(X.chunk_map(spark, sf), [wanted]).agg(F.min("sequence").alias("sequence"), F.min_by("source_offset", "sequence").alias("source_offset"))


@query("file_by_ref", "SELECT file_id, partition_id, path FROM fx_file_index WHERE file_id = 123 AND partition_id = 'volume-3' AND NOT is_directory AND NOT is_deleted")
def file_by_ref(spark, sf):
    return X.file_index(spark, sf).where((F.col("file_id") == S.parse_file_id(F.lit("file-000123"))) & (F.col("partition_id") == "volume-3") & ~F.col("is_directory") & ~F.col("is_deleted")).select("file_id", "partition_id", "path")


@query("list_files", "SELECT file_id, path, size_bytes FROM fx_file_index WHERE partition_id = 'volume-2'")
def list_files(spark, sf):
    return X.file_index(spark, sf).where("partition_id = 'volume-2'").select("file_id", "path", "size_bytes")


@query("get_file", "SELECT file_id, path FROM fx_file_index WHERE file_id = 42")
def get_file(spark, sf):
    return X.file_index(spark, sf).where("file_id = 42").select("file_id", "path").limit(1)


@query("live_files", "SELECT file_id, path FROM fx_file_index WHERE NOT is_directory AND NOT is_deleted")
def live_files(spark, sf):
    return X.file_index(spark, sf).where("NOT is_directory AND NOT is_deleted").select("file_id", "path")


@query("job_scope_chunks", "SELECT 'all' AS scope, chunk_id FROM fx_chunk_map UNION ALL SELECT 'list', unnest(['a', 'b', 'c'])")
def job_scope_chunks(spark, sf):
    """`all` stands for every chunk of the map; anything else is a list with commas."""
    listed = spark.range(1).select(F.lit("list").alias("scope"), F.explode(F.filter(F.transform(F.split(F.lit(" a, b ,c,"), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("chunk_id"))
    return X.chunk_map(spark, sf).select(F.lit("all").alias("scope"), "chunk_id").union(listed)


# Registered tools: (tool, approved, roles, layers, capabilities).
TOOLS = (("search", True, ("user", "assistant"), ("evidence", "analysis"), ("read", "write")), ("viewer", True, ("user",), ("Evidence",), ("read",)), ("legacy", False, ("user",), ("evidence",), ("read",)))


def tool_registry(spark):
    return spark.createDataFrame([(t, a, list(r), list(l), list(c)) for t, a, r, l, c in TOOLS], "tool string, approved boolean, roles array<string>, layers array<string>, capabilities array<string>")


def authorize(requests, tools, capability=None):
    """(…, reason): requests (tool, role, layer) against the registry; names compare without case."""
    j = requests.join(F.broadcast(tools), "tool", "left")  # the registry is a configuration file
    has = lambda arr, c: F.exists(arr, lambda x: F.lower(x) == F.lower(c))
    reason = F.when(F.col("approved").isNull(), "unknown_tool").when(~F.col("approved"), "tool_not_approved").when(~has("roles", F.col("role")), "role_not_allowed").when(~has("layers", F.col("layer")), "layer_not_allowed")
    if capability:
        reason = reason.when(~has("capabilities", F.lit(capability)), "capability_missing")
    return j.select(*requests.columns, reason.otherwise("ok").alias("reason"))


RELATIONS["fx_requests"] = "SELECT access_event_id, CASE turn % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'viewer' WHEN 2 THEN 'legacy' ELSE 'other' END AS tool, actor AS role, CASE WHEN conv_id % 2 = 0 THEN 'EVIDENCE' ELSE 'analysis' END AS layer FROM (SELECT 'acc-' || conv_id || '-' || turn AS access_event_id, role AS actor, turn, conv_id FROM conversations)"


def requests(spark, sf):
    t = F.col("turn") % 4
    tool = F.when(t == 0, "search").when(t == 1, "viewer").when(t == 2, "legacy").otherwise("other")
    c = X.read(spark, sf, "conversations")
    return c.select(F.concat(F.lit("acc-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("access_event_id"), tool.alias("tool"), F.col("role"), F.when(F.col("conv_id") % 2 == 0, "EVIDENCE").otherwise("analysis").alias("layer"))


def _authz_sql(cap):
    last = "WHEN tool = 'viewer' THEN 'capability_missing' " if cap == "write" else ""
    return f"SELECT access_event_id, tool, role, layer, CASE WHEN tool = 'other' THEN 'unknown_tool' WHEN tool = 'legacy' THEN 'tool_not_approved' WHEN role = 'user' OR (role = 'assistant' AND tool = 'search') THEN CASE WHEN tool = 'viewer' AND layer = 'analysis' THEN 'layer_not_allowed' {last}ELSE 'ok' END ELSE 'role_not_allowed' END AS reason FROM fx_requests"


@query("authz_read", _authz_sql("read"))
def authz_read(spark, sf):
    return authorize(requests(spark, sf), tool_registry(spark), "read")


@query("authz_write", _authz_sql("write"))
def authz_write(spark, sf):
    return authorize(requests(spark, sf), tool_registry(spark), "write")


@query("authz_capability", "SELECT tool, capability FROM (VALUES ('search', 'read'), ('search', 'write'), ('viewer', 'read'), ('legacy', 'read')) t(tool, capability)")
def authz_capability(spark, sf):
    return tool_registry(spark).select("tool", F.explode("capabilities").alias("capability"))


@query("tool_registry", "SELECT * FROM (VALUES ('search', true, 'user', 'evidence'), ('search', true, 'user', 'analysis'), ('search', true, 'assistant', 'evidence'), ('search', true, 'assistant', 'analysis'), ('viewer', true, 'user', 'Evidence'), ('legacy', false, 'user', 'evidence')) t(tool, approved, role, layer)")
def tool_registry_rows(spark, sf):
    return tool_registry(spark).select("tool", "approved", F.explode("roles").alias("role"), "layers").select("tool", "approved", "role", F.explode("layers").alias("layer"))


_HEX1 = "CAST('0x' || substr(sha256(object_id), 1, 2) AS BIGINT)"


@query("shard_assign", f"SELECT object_id, position % 4 AS by_range, position % 4 AS by_turn, {_HEX1} % 4 AS by_hash FROM fx_scope")
def shard_assign(spark, sf):
    i = scope_inputs(spark, sf)
    return i.select("object_id", H.shard_of("range", 4).alias("by_range"), H.shard_of("round_robin", 4).alias("by_turn"), H.shard_of("hash_modulo", 4).alias("by_hash"))


@query("shard_plan", "SELECT 'job-1' AS parent_job_id, 'hash_modulo' AS strategy, CAST(300 AS BIGINT) AS shard_count, count(*) AS input_count, 'sha256:' || sha256(string_agg(object_id, chr(10) ORDER BY object_id)) AS input_scope_hash FROM fx_scope")
def shard_plan(spark, sf):
    return C.scope_hash(scope_inputs(spark, sf)).select(F.lit("job-1").alias("parent_job_id"), F.lit("hash_modulo").alias("strategy"), F.lit(300).cast("long").alias("shard_count"), F.col("inputs").alias("input_count"), F.col("scope_hash").alias("input_scope_hash"))


@query("shard_manifest", f"SELECT r AS shard_index, 'job-1-shard-' || CASE WHEN r < 10 THEN '0' ELSE '' END || r AS shard_id, count(object_id) AS n, coalesce(string_agg(object_id, ',' ORDER BY position), '') AS ids FROM range(300) t(r) LEFT JOIN fx_scope ON {_HEX1} % 300 = r GROUP BY r")
def shard_manifest(spark, sf):
    return H.manifests(scope_inputs(spark, sf), "job-1", "hash_modulo", 300).withColumn("ids", F.array_join("ids", ","))


RELATIONS["fx_shards"] = f"SELECT 'job-' || (conv_id % 7) AS job_id, 's-' || conv_id AS shard_id, count(*) AS n, conv_id FROM conversations GROUP BY conv_id"
RELATIONS["fx_results"] = "SELECT shard_id, job_id, CASE WHEN conv_id % 7 = 3 OR conv_id % 5 = 2 THEN 'failed' ELSE 'completed' END AS status, n AS assigned, n - CASE WHEN n > 3 THEN 1 ELSE 0 END AS processed, n - CASE WHEN n > 3 THEN 2 ELSE 0 END AS success, CASE WHEN n > 3 THEN 1 ELSE 0 END AS error, 0 AS skipped, CASE WHEN conv_id % 9 = 4 THEN 'sha256:other' ELSE 'sha256:scope' END AS scope_hash, sha256('a' || conv_id) AS artifact_sha256, CASE WHEN conv_id % 11 = 5 THEN NULL WHEN conv_id % 13 = 6 THEN sha256('b') ELSE sha256('a' || conv_id) END AS artifact_actual FROM fx_shards WHERE conv_id % 6 <> 1 AND conv_id % 7 <> 0 OR conv_id % 7 = 0"


def planned(spark, sf):
    c = X.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("conv_id")
    return c.select(F.concat(F.lit("job-"), (k % 7).cast("string")).alias("job_id"), F.concat(F.lit("s-"), k.cast("string")).alias("shard_id"), "n", "conv_id")


def shard_results(spark, sf):
    k, n = F.col("conv_id"), F.col("n")
    one = F.when(n > 3, 1).otherwise(0)
    kept = planned(spark, sf).where((k % 6 != 1) & (k % 7 != 0) | (k % 7 == 0))
    own = F.sha2(F.concat(F.lit("a"), k.cast("string")), 256)
    return kept.select(
        "shard_id", "job_id", F.when((k % 7 == 3) | (k % 5 == 2), "failed").otherwise("completed").alias("status"), n.alias("assigned"), (n - one).alias("processed"), (n - 2 * one).alias("success"), one.alias("error"),
        F.lit(0).alias("skipped"), F.when(k % 9 == 4, "sha256:other").otherwise("sha256:scope").alias("scope_hash"), own.alias("artifact_sha256"), F.when(k % 11 == 5, F.lit(None)).when(k % 13 == 6, F.sha2(F.lit("b"), 256)).otherwise(own).alias("artifact_actual"),
    )


@query("agg_coverage", "SELECT (SELECT count(*) FROM fx_scope) AS in_scope, CAST(sum(assigned) AS BIGINT) AS assigned, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(success) AS BIGINT) AS success, CAST(sum(error) AS BIGINT) AS error, CAST(sum(skipped) AS BIGINT) AS skipped FROM fx_results")
def agg_coverage(spark, sf):
    return H.coverage(shard_results(spark, sf), scope_inputs(spark, sf))


@query("agg_job_status", "SELECT p.job_id, count(*) FILTER (r.status = 'completed') AS completed, count(*) FILTER (r.status IS DISTINCT FROM 'completed') AS failed, CASE WHEN count(*) FILTER (r.status IS DISTINCT FROM 'completed') = 0 THEN 'completed' WHEN count(*) FILTER (r.status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS status FROM fx_shards p LEFT JOIN fx_results r ON r.shard_id = p.shard_id GROUP BY p.job_id")
def agg_job_status(spark, sf):
    return H.job_status(planned(spark, sf), shard_results(spark, sf))


RELATIONS["fx_members"] = "SELECT object_id, 's-' || (doc_id % 12) AS shard_id FROM fx_doc_objects UNION ALL SELECT object_id, 's-x' FROM fx_doc_objects WHERE doc_id % 40 = 0 UNION ALL SELECT object_id, 's-' || (doc_id % 12) FROM fx_doc_objects WHERE doc_id % 60 = 1"


def members(spark, sf):
    d = X.doc_objects(spark, sf).select("object_id", "doc_id")
    own = F.concat(F.lit("s-"), (F.col("doc_id") % 12).cast("string")).alias("shard_id")
    return d.select("object_id", own).union(d.where("doc_id % 40 = 0").select("object_id", F.lit("s-x"))).union(d.where("doc_id % 60 = 1").select("object_id", own))


@query("agg_dup_inputs", "SELECT object_id, string_agg(DISTINCT shard_id, ',' ORDER BY shard_id) AS shards FROM fx_members GROUP BY object_id HAVING count(DISTINCT shard_id) > 1")
def agg_dup_inputs(spark, sf):
    return H.duplicate_inputs(members(spark, sf))


@query("agg_shard_stats", "SELECT role AS shard_id, count(*) FILTER (turn % 4 <> 3) AS processed, count(*) FILTER (turn % 4 = 0) AS success, count(*) FILTER (turn % 4 = 1) AS error, count(*) FILTER (turn % 4 = 2) AS skipped FROM conversations GROUP BY role")
def agg_shard_stats(spark, sf):
    k = F.col("turn") % 4
    o = F.when(k == 0, "result").when(k == 1, "error").when(k == 2, "skip").otherwise("other")
    return H.statistics(X.read(spark, sf, "conversations").select(F.col("role").alias("shard_id"), o.alias("outcome")))


RELATIONS["fx_shard_issues"] = """
SELECT 'missing_shard_manifest' AS kind, shard_id AS id FROM fx_shards WHERE conv_id % 10 = 9
UNION ALL SELECT 'missing_result', shard_id FROM fx_shards WHERE shard_id NOT IN (SELECT shard_id FROM fx_results)
UNION ALL SELECT 'scope_hash_mismatch', shard_id FROM fx_results WHERE scope_hash <> 'sha256:scope'
UNION ALL SELECT 'artifact_unreadable', shard_id FROM fx_results WHERE artifact_actual IS NULL
UNION ALL SELECT 'artifact_hash_mismatch', shard_id FROM fx_results WHERE artifact_actual <> artifact_sha256
UNION ALL SELECT 'duplicate_input', object_id FROM fx_members GROUP BY object_id HAVING count(DISTINCT shard_id) > 1"""


def shard_issues(spark, sf):
    p = planned(spark, sf)
    return H.issues(p, p.where("conv_id % 10 <> 9").select("shard_id"), shard_results(spark, sf), members(spark, sf), "sha256:scope")


@query("shard_validate", "SELECT kind, id FROM fx_shard_issues")
def shard_validate(spark, sf):
    return shard_issues(spark, sf)


@query("job_finalize", "SELECT p.job_id, count(*) AS shard_count, count(*) FILTER (r.status = 'completed') AS completed, count(*) FILTER (r.status IS DISTINCT FROM 'completed') AS failed, CASE WHEN count(*) FILTER (r.status IS DISTINCT FROM 'completed') = 0 THEN 'completed' WHEN count(*) FILTER (r.status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS status, CAST(coalesce(sum(r.processed), 0) AS BIGINT) AS processed, CAST(coalesce(sum(r.error), 0) AS BIGINT) AS error FROM fx_shards p LEFT JOIN fx_results r ON r.shard_id = p.shard_id GROUP BY p.job_id")
def job_finalize(spark, sf):
    plan, results = planned(spark, sf), shard_results(spark, sf)
    sums = results.groupBy("job_id").agg(F.sum("processed").alias("processed"), F.sum("error").alias("error"))
    counts = plan.groupBy("job_id").agg(F.count(F.lit(1)).alias("shard_count"))
    return counts.join(H.job_status(plan, results), "job_id").join(sums, "job_id", "left").fillna(0, ["processed", "error"])


@query("job_run", "SELECT job_id, arg_max(state, seq) AS state, count(*) FILTER (state = 'retry') AS retries FROM (SELECT 'job-' || user_id AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'view' THEN 'running' WHEN 'click' THEN 'retry' WHEN 'error' THEN 'failed' ELSE 'completed' END AS state FROM events) GROUP BY job_id")
def job_run(spark, sf):
    """State of each job after its log: the last line counts."""
    t = F.col("event_type")
    state = F.when(t == "signup", "planned").when(t == "view", "running").when(t == "click", "retry").when(t == "error", "failed").otherwise("completed")
    log = X.read(spark, sf, "events").select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), state.alias("state"))
    return log.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.count_if(F.col("state") == "retry").alias("retries"))


def materialised(files, chunks=None):
    """(objects, edges, derivations) of file rows; content hashes are left to later unless chunks are given."""
    oid = S.object_id(F.col("partition_id"), F.col("file_id"), F.col("path"))
    fs = F.concat(F.lit("obj-fs-"), F.col("partition_id"))
    live = files.where("NOT is_directory AND NOT is_deleted")
    f = live.select(oid.alias("object_id"), F.lit("filesystem_file").alias("object_type"), F.col("filename").alias("name"), S.normalize_path(F.col("path")).alias("logical_path"), "size_bytes", F.lit("deferred").alias("content_hash_status"))
    nodes = live.select(fs.alias("object_id")).distinct().select("object_id", F.lit("filesystem").alias("object_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("logical_path"), F.lit(None).cast("long").alias("size_bytes"), F.lit("not_applicable").alias("content_hash_status"))
    e = live.select(S.edge_id(fs, oid, F.lit("contains")).alias("edge_id"), fs.alias("parent_object_id"), oid.alias("child_object_id"), F.lit("contains").alias("relation_type"))
    d = live.select(S.derivation_id(fs, oid).alias("derivation_id"), fs.alias("parent_object_id"), oid.alias("child_object_id"), F.lit("filesystem_parse").alias("method"))
    return f.unionByName(nodes), e, d


RELATIONS["fx_fs_objects"] = "SELECT 'obj-fsfile-' || substr(sha256(partition_id || '|' || file_id || '|' || path), 1, 24) AS object_id, 'obj-fs-' || partition_id AS fs, filename, '/' || path AS logical_path, size_bytes FROM fx_file_index WHERE NOT is_directory AND NOT is_deleted"


@query("materialise_objects", "SELECT object_id, 'filesystem_file' AS object_type, filename AS name, logical_path, size_bytes, 'deferred' AS content_hash_status FROM fx_fs_objects UNION ALL SELECT DISTINCT fs, 'filesystem', NULL, NULL, NULL, 'not_applicable' FROM fx_fs_objects")
def materialise_objects(spark, sf):
    return materialised(X.file_index(spark, sf))[0]


@query("materialise_edges", "SELECT 'edge-' || substr(sha256(fs || '|' || object_id || '|contains'), 1, 24) AS edge_id, fs AS parent_object_id, object_id AS child_object_id, 'contains' AS relation_type FROM fx_fs_objects")
def materialise_edges(spark, sf):
    return materialised(X.file_index(spark, sf))[1]


@query("materialise_derivations", "SELECT 'drv-' || substr(sha256(fs || '|' || object_id), 1, 24) AS derivation_id, fs AS parent_object_id, object_id AS child_object_id, 'filesystem_parse' AS method FROM fx_fs_objects")
def materialise_derivations(spark, sf):
    return materialised(X.file_index(spark, sf))[2]


@query("scan_file_index_resolution", "SELECT f.file_id, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunk_refs FROM fx_file_index f JOIN fx_chunk_map ON source_offset < extent_offset + extent_length AND source_offset + source_length > extent_offset WHERE NOT is_directory AND NOT is_deleted GROUP BY f.file_id")
def scan_file_index_resolution(spark, sf):
    live = X.file_index(spark, sf).where("NOT is_directory AND NOT is_deleted").select("file_id")
    return file_chunks(spark, sf).join(live, "file_id", "left_semi").select("file_id", F.array_join("chunk_refs", ",").alias("chunk_refs"))


@query("collect", "SELECT 'obj-' || substr(sha256(text), 1, 16) AS object_id, min(source || '/' || doc_id || '.' || lang) AS first_path, count(*) AS files, min(CAST(octet_length(encode(text)) AS BIGINT)) AS size_bytes, 'sha256:' || sha256(text) AS storage_ref FROM documents GROUP BY text")
def collect(spark, sf):
    """Files by content: equal files are one object and one blob."""
    d = X.read(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.octet_length("text").cast("long").alias("n"))
    g = d.groupBy("h").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("files"), F.min("n").alias("size_bytes"))
    return g.select(S.collect_object_id(F.col("h")).alias("object_id"), "first_path", "files", "size_bytes", S.tagged(F.col("h")).alias("storage_ref"))
