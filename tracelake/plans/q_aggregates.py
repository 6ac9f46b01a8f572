"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merkle as M
from ..operators import replay as R
from ..registry import RELATIONS, query
from ..sources import fixtures as X

RELATIONS["fx_tree"] = """
SELECT level, i, h FROM (WITH RECURSIVE lv(level, nodes) AS (
  SELECT CAST(0 AS BIGINT), list(plaintext_sha256 ORDER BY sequence) FROM fx_chunk_map
  UNION ALL SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(unhex(nodes[k]) || unhex(coalesce(nodes[k + 1], nodes[k])))) FROM lv WHERE len(nodes) > 1)
  SELECT level, unnest(range(0, len(nodes))) AS i, unnest(nodes) AS h FROM lv)"""


@query("agg_merkle_root", "SELECT (SELECT count(*) FROM fx_chunk_map) AS leaves, h AS root FROM fx_tree ORDER BY level DESC LIMIT 1")
def agg_merkle_root(spark, sf):
    return M.root(X.leaves(spark, sf))


@query("agg_merkle_tree", "SELECT level, i, h FROM fx_tree")
def agg_merkle_tree(spark, sf):
    return M.tree(X.leaves(spark, sf)).withColumn("level", F.col("level").cast("long"))


RELATIONS["fx_bad_tree"] = "SELECT level, i, CASE WHEN level = 2 AND i % 50 = 7 THEN sha256('bad') ELSE h END AS h FROM fx_tree"


@query("merkle_validate", "SELECT CAST(t.level AS BIGINT) AS level, t.i FROM fx_bad_tree t JOIN fx_bad_tree a ON a.level = t.level - 1 AND a.i = 2 * t.i LEFT JOIN fx_bad_tree b ON b.level = t.level - 1 AND b.i = 2 * t.i + 1 WHERE t.h <> sha256(unhex(a.h) || unhex(coalesce(b.h, a.h)))")
def merkle_validate(spark, sf):
    nodes = M.tree(X.leaves(spark, sf)).withColumn("h", F.when((F.col("level") == 2) & (F.col("i") % 50 == 7), F.sha2(F.lit("bad"), 256)).otherwise(F.col("h")))
    return M.invalid_nodes(nodes).withColumn("level", F.col("level").cast("long"))


@query("merkle_proof", "SELECT t.level, CASE WHEN (137 // CAST(pow(2, t.level) AS BIGINT)) % 2 = 1 THEN 'left' ELSE 'right' END AS side, t.h AS sibling FROM fx_tree t JOIN (SELECT level, max(i) AS top FROM fx_tree GROUP BY level) s ON s.level = t.level WHERE top > 0 AND t.i = least(xor(137 // CAST(pow(2, t.level) AS BIGINT), 1), top)")
def merkle_proof(spark, sf):
    return M.proof(M.tree(X.leaves(spark, sf)), 137).withColumn("level", F.col("level").cast("long"))


@query("merkle_verify", "SELECT h AS root, true AS ok FROM fx_tree ORDER BY level DESC LIMIT 1")
def merkle_verify(spark, sf):
    nodes = M.tree(X.leaves(spark, sf))
    leaf = nodes.where("level = 0 AND i = 137").first()["h"]
    top = nodes.groupBy().agg(F.max_by("h", "level").alias("top"))
    return M.fold_proof(M.proof(nodes, 137), leaf).join(F.broadcast(top), F.lit(True)).select("root", (F.col("root") == F.col("top")).alias("ok"))


@query("agg_source_hash", "SELECT sha256(string_agg(n_name, '' ORDER BY n_nationkey)) AS digest, CAST(sum(length(n_name)) AS BIGINT) AS bytes FROM nation")
def agg_source_hash(spark, sf):
    """A digest of an ordered concatenation is sequential by nature; a stream of blobs goes through sinks.stream_digest()."""
    rows = X.read(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 19, "0").alias("k"), "n_name")
    size = X.read(spark, sf, "nation").agg(F.sum(F.octet_length("n_name")).alias("bytes"))
    return ordered_digest(rows, "k", F.col("n_name")).join(F.broadcast(size), F.lit(True))  # one row with one row


def ordered_digest(df, key, *parts):
    """SHA-256 over the parts of all rows, in the order of a unique text key, as one text."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.concat(*parts).alias("v")))).alias("l"))
    return rows.select(F.sha2(F.array_join(F.transform("l", lambda x: x["v"]), ""), 256).alias("digest"))


@query("agg_collection_hash", "SELECT sha256(string_agg(path || chr(10) || sha256(p_brand) || chr(10), '' ORDER BY path)) AS digest FROM (SELECT p_brand, p_type || '/' || p_partkey AS path FROM part)")
def agg_collection_hash(spark, sf):
    p = X.read(spark, sf, "part").select(F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_brand", 256).alias("h"))
    return ordered_digest(p, "path", F.col("path"), F.lit("\n"), F.col("h"), F.lit("\n"))


@query("agg_dup_objects", "SELECT object_id, count(*) AS n FROM (SELECT object_id FROM fx_objects UNION ALL SELECT object_id FROM fx_objects WHERE object_type = 'filesystem') GROUP BY object_id HAVING count(*) > 1")
def agg_dup_objects(spark, sf):
    o = X.objects(spark, sf).select("object_id", "object_type")
    return o.union(o.where("object_type = 'filesystem'")).groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("agg_root_summary", "SELECT r.root_id, r.status, coalesce(o.n, 0) AS objects, coalesce(e.n, 0) AS edges, coalesce(d.n, 0) AS derivations FROM fx_roots r LEFT JOIN (SELECT root_id, count(*) AS n FROM fx_objects GROUP BY 1) o ON o.root_id = r.root_id LEFT JOIN (SELECT parent_root_id AS root_id, count(*) AS n FROM fx_edges GROUP BY 1) e ON e.root_id = r.root_id LEFT JOIN (SELECT parent_root_id AS root_id, count(*) AS n FROM fx_derivations GROUP BY 1) d ON d.root_id = r.root_id")
def agg_root_summary(spark, sf):
    out = X.roots(spark, sf).select("root_id", "status")
    for name, df, col in (("objects", X.objects(spark, sf), "root_id"), ("edges", X.edges(spark, sf), "parent_root_id"), ("derivations", X.derivations(spark, sf), "parent_root_id")):
        out = out.join(df.groupBy(F.col(col).alias("root_id")).agg(F.count(F.lit(1)).alias(name)), "root_id", "left")
    return out.fillna(0, ["objects", "edges", "derivations"])


@query("agg_case_summary", "SELECT count(*) AS objects, count(DISTINCT root_id) AS roots, count(*) FILTER (root_id IS NULL) AS without_root, (SELECT count(*) FROM fx_edges WHERE parent_root_id <> child_root_id) AS cross_root FROM fx_objects")
def agg_case_summary(spark, sf):
    o = X.objects(spark, sf).agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("root_id").alias("roots"), F.count_if(F.col("root_id").isNull()).alias("without_root"))
    x = X.edges(spark, sf).agg(F.count_if(F.coalesce(F.col("parent_root_id") != F.col("child_root_id"), F.lit(False))).alias("cross_root"))
    return o.join(F.broadcast(x), F.lit(True))  # one row with one row


@query("agg_root_verify_summary", "SELECT count(*) FILTER (s = 'valid') AS valid, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'offline') AS offline FROM (SELECT CASE WHEN availability = 'offline' THEN 'offline' WHEN status = 'detached' THEN 'warning' WHEN root_id = 'root-2' THEN 'missing' WHEN root_id = 'root-1' THEN 'invalid' ELSE 'valid' END AS s FROM fx_roots)")
def agg_root_verify_summary(spark, sf):
    r = X.roots(spark, sf)
    s = F.when(F.col("availability") == "offline", "offline").when(F.col("status") == "detached", "warning").when(F.col("root_id") == "root-2", "missing").when(F.col("root_id") == "root-1", "invalid").otherwise("valid")
    return r.select(s.alias("s")).agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("valid", "warning", "invalid", "missing", "offline")])


@query("agg_fs_stats", "SELECT partition_id, count(*) AS total, count(*) FILTER (NOT is_directory AND NOT is_deleted) AS live_files, count(*) FILTER (is_directory AND NOT is_deleted) AS live_directories, count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (parser_status = 'partial') AS partial, count(*) FILTER (parser_status = 'error') AS error FROM fx_file_index GROUP BY partition_id")
def agg_fs_stats(spark, sf):
    d, x = F.col("is_directory"), F.col("is_deleted")
    return X.file_index(spark, sf).groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~d & ~x).alias("live_files"), F.count_if(d & ~x).alias("live_directories"), F.count_if(x).alias("deleted"),
        F.count_if(F.col("parser_status") == "partial").alias("partial"), F.count_if(F.col("parser_status") == "error").alias("error"),
    )


def report_counts(checks, by):
    """ok, warn and fail of checks (status), and the worst of them as the overall status."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail")}
    out = checks.groupBy(*by).agg(*n.values())
    return out.withColumn("overall", F.when(F.col("fail") > 0, "fail").when(F.col("warn") > 0, "warning").otherwise("pass"))


@query("agg_report_counts", "SELECT source, ok, warn, fail, CASE WHEN fail > 0 THEN 'fail' WHEN warn > 0 THEN 'warning' ELSE 'pass' END AS overall FROM (SELECT source, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'warn') AS warn, count(*) FILTER (s = 'fail') AS fail FROM (SELECT source, CASE WHEN doc_id % 410 = 0 THEN 'fail' WHEN parser_status = 'partial' THEN 'warn' ELSE 'ok' END AS s FROM fx_doc_objects) GROUP BY source)")
def agg_report_counts(spark, sf):
    s = F.when(F.col("doc_id") % 410 == 0, "fail").when(F.col("parser_status") == "partial", "warn").otherwise("ok")
    return report_counts(X.doc_objects(spark, sf).select("source", s.alias("status")), ["source"])


RELATIONS["fx_deltas"] = "SELECT 'obj-' || (event_id % 300) AS object_id, 'job-' || (event_id % 11) AS job_dir, event_id // 11 AS line, event_type AS object_type, value FROM events WHERE event_type <> 'view' UNION ALL SELECT 'obj-' || (event_id % 300), 'job-' || (event_id % 11), event_id // 11 + 100000, 'again', value FROM events WHERE event_id % 5 = 0"


def deltas(spark, sf):
    e = X.read(spark, sf, "events")
    i = F.col("event_id")
    row = lambda df, kind, more: df.select(F.concat(F.lit("obj-"), (i % 300).cast("string")).alias("object_id"), F.concat(F.lit("job-"), (i % 11).cast("string")).alias("job_dir"), (F.call_function("div", i, F.lit(11)) + more).alias("line"), kind.alias("object_type"), "value")
    return row(e.where("event_type <> 'view'"), F.col("event_type"), 0).union(row(e.where("event_id % 5 = 0"), F.lit("again"), 100000))


RELATIONS["fx_existing"] = "SELECT 'obj-' || p_partkey AS object_id, 'existing' AS object_type, p_retailprice AS value FROM part WHERE p_partkey % 3 = 0"


def existing(spark, sf):
    return X.read(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("obj-"), F.col("p_partkey").cast("string")).alias("object_id"), F.lit("existing").alias("object_type"), F.col("p_retailprice").alias("value"))


@query("agg_first_writer", "SELECT object_id, object_type, value, job_dir, line FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY job_dir, line) AS r FROM fx_deltas) WHERE r = 1")
def agg_first_writer(spark, sf):
    return R.first_writer(deltas(spark, sf), "object_id", ["job_dir", "line"])


@query("merge_indexes", "SELECT object_id, object_type, value FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY s, job_dir, line) AS r FROM (SELECT object_id, object_type, value, 0 AS s, job_dir, line FROM fx_deltas UNION ALL SELECT object_id, object_type, value, 1, '', 0 FROM fx_existing)) WHERE r = 1")
def merge_indexes(spark, sf):
    return R.merge_indexes(deltas(spark, sf), existing(spark, sf), "object_id").select("object_id", "object_type", "value")


@query("agg_chunk_dedup", "SELECT count(*) AS rows, count(DISTINCT chunk_id) AS chunks, CAST(sum(stored_length) - (SELECT sum(l) FROM (SELECT min(stored_length) AS l FROM fx_chunk_map GROUP BY chunk_id)) AS BIGINT) AS saved FROM fx_chunk_map")
def agg_chunk_dedup(spark, sf):
    per = X.chunk_map(spark, sf).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stored_length").alias("all"), F.min("stored_length").alias("one"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("chunks"), F.sum(F.col("all") - F.col("one")).alias("saved"))


@query("replay_objects", "SELECT object_id, event_type, payload_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) AS r FROM fx_object_events WHERE event_type = 'removed' OR (event_type IN ('discovered', 'updated') AND payload_value IS NOT NULL)) WHERE r = 1 AND event_type <> 'removed'")
def replay_objects(spark, sf):
    return R.replay_objects(X.object_events(spark, sf)).select("object_id", "event_type", "payload_value", "seq")


@query("replay_objects_sdk", "SELECT object_id, event_type, payload_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) AS r FROM fx_object_events WHERE event_type IN ('removed', 'discovered', 'updated')) WHERE r = 1 AND event_type <> 'removed'")
def replay_objects_sdk(spark, sf):
    return R.replay_objects(X.object_events(spark, sf), null_payload_counts=True).select("object_id", "event_type", "payload_value", "seq")


@query("replay_edges", "SELECT edge_id, source_object_id, target_object_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY seq DESC) AS r FROM fx_edge_events WHERE event_type IN ('discovered', 'removed')) WHERE r = 1 AND event_type = 'discovered'")
def replay_edges(spark, sf):
    return R.replay_edges(X.edge_events(spark, sf)).select("edge_id", "source_object_id", "target_object_id", "seq")


@query("union_case", "SELECT object_id, object_type, coalesce(root_id, 'root-' || (CAST(substr(object_id, 2) AS BIGINT) % 2)) AS root_id FROM fx_objects")
def union_case(spark, sf):
    o = X.objects(spark, sf).select("object_id", "object_type", "root_id")
    half = lambda k: o.where(F.substring("object_id", 2, 20).cast("long") % 2 == k)
    return R.union_case({"root-0": half(0), "root-1": half(1)})


@query("cross_root_relations", "SELECT 'edge' AS kind, edge_id AS id, parent_root_id, child_root_id FROM fx_edges WHERE parent_root_id <> child_root_id UNION ALL SELECT 'derivation', derivation_id, parent_root_id, child_root_id FROM fx_derivations WHERE parent_root_id <> child_root_id")
def cross_root_relations(spark, sf):
    return R.cross_root(X.edges(spark, sf), X.derivations(spark, sf))


@query("cross_root_count_verify", "SELECT count(*) FILTER (parent_root_id <> child_root_id) AS known, count(*) FILTER (parent_root_id IS DISTINCT FROM child_root_id) AS with_unknown FROM fx_edges")
def cross_root_count_verify(spark, sf):
    p, c = F.col("parent_root_id"), F.col("child_root_id")
    return X.edges(spark, sf).agg(F.count_if(F.coalesce(p != c, F.lit(False))).alias("known"), F.count_if(~p.eqNullSafe(c)).alias("with_unknown"))


@query("delta_idempotence", "SELECT 'same' AS pair, true AS equal UNION ALL SELECT 'changed', false")
def delta_idempotence(spark, sf):
    a = existing(spark, sf)
    changed = a.withColumn("value", F.when(F.col("object_id") == "obj-3", 0.0).otherwise(F.col("value")))
    return spark.createDataFrame([("same", R.same_rows(a, existing(spark, sf))), ("changed", R.same_rows(a, changed))], "pair string, equal boolean")


@query("ext_paths_flatten")
def ext_paths_flatten(spark, sf):
    """String leaves of JSON values: variants are exploded a level at a time."""
    v = X.read(spark, sf, "events").select("event_id", F.concat(F.lit('{"files":["a/'), F.col("event_type"), F.lit('",{"x":"b"}],"n":1,"props":'), F.col("props"), F.lit("}")).alias("j"))
    return flatten_strings(v, "event_id", "j")


def flatten_strings(df, key, column, depth=4):
    """(key, path, value) of the string leaves of a JSON text, to a depth."""
    cur = df.select(key, F.parse_json(column).alias("v"), F.lit("$").alias("path"))
    out = None
    for _ in range(depth):
        cur.createOrReplaceTempView("_variants")
        nxt = cur.sparkSession.sql(f"SELECT {key}, e.value AS v, path || coalesce('.' || e.key, '[' || e.pos || ']') AS path FROM _variants, LATERAL variant_explode(v) AS e")
        leaf = nxt.where(F.schema_of_variant("v") == "STRING").select(key, "path", F.variant_get("v", "$", "string").alias("value"))
        out = leaf if out is None else out.union(leaf)
        cur = nxt.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
    return out


@query("sort_case_objects", "SELECT row_number() OVER (ORDER BY root_id NULLS FIRST, object_id) AS position, root_id, object_id FROM fx_objects WHERE object_type IN ('container', 'directory')")
def sort_case_objects(spark, sf):
    w = Window.orderBy(F.asc_nulls_first("root_id"), "object_id")
    o = X.objects(spark, sf).where(F.col("object_type").isin("container", "directory"))
    return o.select(F.row_number().over(w).cast("long").alias("position"), "root_id", "object_id")


@query("page_objects", "SELECT object_id, object_type FROM fx_objects ORDER BY object_id LIMIT 50 OFFSET 100")
def page_objects(spark, sf):
    return X.objects(spark, sf).select("object_id", "object_type").orderBy("object_id").offset(100).limit(50)


@query("sample_readable", "SELECT object_id, size_bytes FROM fx_doc_objects WHERE parser_status = 'ok' AND size_bytes IS NOT NULL ORDER BY object_id LIMIT 10")
def sample_readable(spark, sf):
    return X.doc_objects(spark, sf).where("parser_status = 'ok' AND size_bytes IS NOT NULL").select("object_id", "size_bytes").orderBy("object_id").limit(10)
