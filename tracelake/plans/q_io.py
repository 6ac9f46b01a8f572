"""Queries that write tables, logs and blobs in the container's layout and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.udfs import compress
from ..registry import RELATIONS, query
from ..sources import fixtures as X
from ..sources import packed, readers, schemas, sinks
from ..sources.store import shared_dir
from .q_jobs import set_members


def _empty(kind="string"):
    return F.lit(None).cast(kind)


@query("scan_chunk_map", "SELECT sequence, source_offset, source_length, chunk_id, stored_length, compression, plaintext_sha256, stored_sha256 FROM fx_chunk_map")
def scan_chunk_map(spark, sf):
    root = shared_dir(spark)
    sinks.table(X.chunk_map(spark, sf), f"{root}/indexes/physical_to_chunk.parquet", schemas.CHUNK_MAP, sort="sequence")
    return readers.chunk_map(spark, root)


@query("scan_leaves", "SELECT sequence, chunk_id, plaintext_sha256 FROM fx_leaves")
def scan_leaves(spark, sf):
    root = shared_dir(spark)
    sinks.table(X.leaves(spark, sf), f"{root}/integrity/leaves.parquet", schemas.LEAVES, sort="sequence")
    return readers.leaves(spark, root)


def file_rows(spark, sf):
    """File rows in the table's own columns; extents as JSON text."""
    f = X.file_index(spark, sf)
    extents = F.to_json(F.array(F.struct(F.col("extent_offset").alias("offset"), F.col("extent_length").alias("length"))))
    return f.withColumns({"filesystem_id": F.concat(F.lit("ntfs-"), "partition_id"), "physical_extents": extents, "chunk_refs": F.lit("[]")})


@query("scan_file_index", "SELECT file_id, partition_id, path, filename, extension, size_bytes, is_directory, is_deleted, false AS is_sparse, parser_status, extent_offset, extent_length, partition_id AS volume FROM fx_file_index")
def scan_file_index(spark, sf):
    root, rows = shared_dir(spark), file_rows(spark, sf).drop("extent_offset", "extent_length")
    for v in range(4):  # volumes are few; each has a folder
        part = rows.where(F.col("partition_id") == f"volume-{v}")
        sinks.table(part, f"{root}/indexes/filesystems/volume-{v}/file_index.parquet", T.StructType([x for x in schemas.FILE_INDEX.fields if x.name in part.columns]))
    e = F.from_json("physical_extents", "array<struct<offset:bigint,length:bigint>>")[0]
    cols = ["file_id", "partition_id", "path", "filename", "extension", "size_bytes", "is_directory", "is_deleted", "is_sparse", "parser_status"]
    return readers.file_index(spark, root).select(*cols, e["offset"].alias("extent_offset"), e["length"].alias("extent_length"), "volume")


def object_rows(spark, sf):
    return X.objects(spark, sf).withColumns({"source_layer": F.lit("evidence"), "parser_status": F.lit("ok"), "schema_version": F.lit("0.2.0")})


def edge_rows(spark, sf):
    return X.edges(spark, sf).withColumn("schema_version", F.lit("0.2.0"))


def derivation_rows(spark, sf):
    d = X.derivations(spark, sf)
    return d.withColumns({c: F.lit(v) for c, v in {"job_id": "job-1", "tool_id": "t", "tool_name": "tool", "tool_version": "1.0.0", "storage_mode": "derived", "created_at": "", "schema_version": "0.2.0"}.items()})


def write_graph(spark, sf, root, rows_per_file=0):
    sinks.table(object_rows(spark, sf), f"{root}/indexes/objects/object_index.parquet", schemas.OBJECT_INDEX, rows_per_file, "object_id")
    sinks.table(edge_rows(spark, sf), f"{root}/indexes/objects/object_edges.parquet", schemas.OBJECT_EDGES, rows_per_file, "edge_id")
    sinks.table(derivation_rows(spark, sf), f"{root}/indexes/objects/derivations.parquet", schemas.DERIVATIONS, rows_per_file, "derivation_id")


_TABLES = {
    "objects": (readers.objects, "fx_objects", ["object_id", "object_type", "name", "size_bytes", "root_id", "sha256"], object_rows, "object_index", schemas.OBJECT_INDEX, "object_id"),
    "edges": (readers.edges, "fx_edges", ["edge_id", "parent_object_id", "child_object_id", "parent_root_id", "child_root_id", "relation_type"], edge_rows, "object_edges", schemas.OBJECT_EDGES, "edge_id"),
    "derivations": (readers.derivations, "fx_derivations", ["derivation_id", "parent_object_id", "child_object_id", "input_sha256", "output_sha256", "method"], derivation_rows, "derivations", schemas.DERIVATIONS, "derivation_id"),
}
for _name, (_read, _rel, _cols, _rows, _file, _schema, _key) in _TABLES.items():

    @query(f"scan_{_name}", f"SELECT {', '.join(_cols)} FROM {_rel}")
    def _scan(spark, sf, read=_read, cols=_cols, rows=_rows, file=_file, schema=_schema, key=_key):
        root = shared_dir(spark)
        sinks.table(rows(spark, sf), f"{root}/indexes/objects/{file}.parquet", schema, sort=key)
        return read(spark, root).select(*cols)

    @query(f"scan_{_name}_batched", f"SELECT CAST((count(*) + 999) // 1000 AS BIGINT) AS batches, count(*) AS rows FROM {_rel}")
    def _batched(spark, sf, read=_read, rows=_rows, file=_file, schema=_schema, key=_key):
        """Files of 500 rows, handed on in lists of 1000."""
        root = shared_dir(spark)
        sinks.table(rows(spark, sf), f"{root}/indexes/objects/{file}.parquet", schema, 500)
        lists = readers.batched(read(spark, root).select(key), 1000)
        return lists.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).cast("long").alias("rows"))


def _log(spark, df, kind):
    root = shared_dir(spark)
    sinks.append_log(df, f"{root}/{schemas.LOG_FILES[kind]}")
    return readers.extension_log(spark, root, kind)


def _at(name):
    return F.lit("2026-01-01T00:00:00Z").alias(name)


_TGT = "struct('object' AS type, {0} AS id) AS target"


@query("scan_jsonl", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS missing FROM labels")
def scan_jsonl(spark, sf):
    root = shared_dir(spark)
    X.label_events(spark, sf).select(F.to_json(F.struct("label_event_id", "label"))).union(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(f"{root}/log")
    read = readers.jsonl(spark, f"{root}/log", "label_event_id string, label string").agg(F.count("label").alias("rows"))
    none = readers.jsonl(spark, f"{root}/absent", "a string").agg(F.count(F.lit(1)).alias("missing"))
    return read.join(F.broadcast(none), F.lit(True))  # one row with one row


@query("scan_ext_labels", "SELECT label_event_id, 'object' AS target_type, target_id, label FROM fx_label_events")
def scan_ext_labels(spark, sf):
    df = X.label_events(spark, sf).select("label_event_id", _at("timestamp"), F.lit("user").alias("actor"), F.expr(_TGT.format("target_id")), "label")
    return _log(spark, df, "labels").select("label_event_id", F.col("target.type").alias("target_type"), F.col("target.id").alias("target_id"), "label")


@query("scan_ext_scopes", "SELECT 'scope-' || n_nationkey AS scope_id, 'n' || n_nationkey AS first_object, CAST(2 AS BIGINT) AS labels FROM nation")
def scan_ext_scopes(spark, sf):
    n = X.read(spark, sf, "nation")
    df = n.select(F.expr("concat('scope-', n_nationkey) AS scope_id"), _at("created_at"), F.lit("user").alias("created_by"), F.expr("struct(array(concat('n', n_nationkey)) AS object_ids) AS include"), F.expr("struct(array('restricted', 'spam') AS labels) AS exclude"))
    return _log(spark, df, "scopes").select("scope_id", F.col("include.object_ids")[0].alias("first_object"), F.size("exclude.labels").cast("long").alias("labels"))


@query("scan_ext_sets", "SELECT set_id, set_type, count(*) AS members FROM fx_sets GROUP BY set_id, set_type")
def scan_ext_sets(spark, sf):
    root = shared_dir(spark)
    g = set_members(spark, sf).groupBy("set_id", "set_type").agg(F.array_sort(F.collect_list("object_id")).alias("ids"))
    g = g.select("set_id", "set_type", _at("created_at"), F.lit("user").alias("created_by"), F.expr("struct(ids AS object_ids) AS members"))
    for kind in ("working", "release", "exclusion"):
        sinks.append_log(g.where(F.col("set_type") == kind), readers.sets_file(root, kind))
    return readers.extension_log(spark, root, "sets").select("set_id", "set_type", F.size("members.object_ids").cast("long").alias("members"))


@query("scan_ext_decisions", "SELECT 'dec-' || doc_id AS decision_id, 'user' AS actor_type, 'obj-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS target_id, CASE WHEN toxic = 1 THEN 'withheld' ELSE 'released' END AS outcome FROM labels")
def scan_ext_decisions(spark, sf):
    df = X.read(spark, sf, "labels").select(F.expr("concat('dec-', doc_id) AS decision_id"), _at("timestamp"), F.expr("struct('user' AS type, 'u1' AS id) AS actor"), F.lit("release").alias("decision_type"), F.expr(_TGT.format("concat('obj-', lpad(doc_id, 12, '0'))")), F.expr("CASE WHEN toxic = 1 THEN 'withheld' ELSE 'released' END AS outcome"))
    return _log(spark, df, "decisions").select("decision_id", F.col("actor.type").alias("actor_type"), F.col("target.id").alias("target_id"), "outcome")


@query("scan_ext_policies", "SELECT 'pol-' || r_regionkey AS policy_ref, 'retention' AS policy_type, r_name AS title FROM region")
def scan_ext_policies(spark, sf):
    df = X.read(spark, sf, "region").select(F.expr("concat('pol-', r_regionkey) AS policy_ref"), F.lit("retention").alias("policy_type"), F.col("r_name").alias("title"))
    return _log(spark, df, "policies").select("policy_ref", "policy_type", "title")


@query("scan_ext_access", "SELECT access_event_id, actor, result FROM fx_access_events WHERE NOT is_denied")
def scan_ext_access(spark, sf):
    df = X.access_events(spark, sf).where("NOT is_denied").select("access_event_id", _at("timestamp"), "actor", F.lit("read").alias("action"), F.expr(_TGT.format("'x'")), "result")
    return _log(spark, df, "access").select("access_event_id", "actor", "result")


@query("scan_ext_denied", "SELECT access_event_id AS denied_event_id, actor, result, 'role_not_allowed' AS reason_code FROM fx_access_events WHERE is_denied")
def scan_ext_denied(spark, sf):
    df = X.access_events(spark, sf).where("is_denied").select(F.col("access_event_id").alias("denied_event_id"), _at("timestamp"), "actor", F.lit("read").alias("action"), F.expr(_TGT.format("'x'")), "result", F.lit("role_not_allowed").alias("reason_code"))
    return _log(spark, df, "denied").select("denied_event_id", "actor", "result", "reason_code")


@query("scan_ext_audit", "SELECT 'aud-' || event_id AS audit_event_id, event_type, 'user-' || user_id AS actor FROM events")
def scan_ext_audit(spark, sf):
    df = X.read(spark, sf, "events").select(F.expr("concat('aud-', event_id) AS audit_event_id"), _at("timestamp"), F.expr("concat('user-', user_id) AS actor"), "event_type")
    return _log(spark, df, "audit").select("audit_event_id", "event_type", "actor")


@query("scan_object_events", "SELECT row_number() OVER (ORDER BY seq) AS seq, 'evt-' || seq AS event_id, object_id, event_type, payload_value FROM fx_object_events")
def scan_object_events(spark, sf):
    root = shared_dir(spark)
    e = X.object_events(spark, sf)
    payload = F.when(F.col("payload_value").isNotNull(), F.to_json(F.struct("object_id", F.col("payload_value").alias("value"))))
    rows = e.select("seq", F.concat(F.lit("evt-"), F.col("seq").cast("string")).alias("event_id"), "event_type", "object_id", payload.alias("payload"))
    sinks.append_ordered(rows, f"{root}/object_events", "seq")
    log = readers.ordered_log(spark, f"{root}/object_events", schemas.LOGS["object_events"])
    return log.select("seq", "event_id", "object_id", "event_type", F.get_json_object("payload", "$.value").cast("double").alias("payload_value"))


@query("scan_edge_events", "SELECT row_number() OVER (ORDER BY seq) AS seq, edge_id, source_object_id, target_object_id, event_type FROM fx_edge_events")
def scan_edge_events(spark, sf):
    root = shared_dir(spark)
    sinks.append_ordered(X.edge_events(spark, sf), f"{root}/edge_events", "seq")
    return readers.ordered_log(spark, f"{root}/edge_events", schemas.LOGS["edge_events"]).select("seq", "edge_id", "source_object_id", "target_object_id", "event_type")


@query("scan_case_provenance", "SELECT line_no + 1 AS seq, event_id, actor, action, tool_name FROM fx_provenance")
def scan_case_provenance(spark, sf):
    root = shared_dir(spark)
    p = X.provenance(spark, sf).select("line_no", "event_id", _at("timestamp"), "actor", "action", F.struct(F.col("tool_name").alias("name"), F.col("tool_version").alias("version")).alias("tool"), F.lit("{}").alias("details"))
    sinks.append_ordered(p, f"{root}/custody", "line_no")
    return readers.ordered_log(spark, f"{root}/custody", schemas.LOGS["custody"]).select("seq", "event_id", "actor", "action", F.col("tool.name").alias("tool_name"))


@query("provenance_iter", "SELECT event_id, actor, action, CASE WHEN line_no % 10 = 0 THEN '' ELSE tool_name END AS tool_name, CASE WHEN line_no % 10 = 0 THEN '' ELSE tool_version END AS tool_version FROM fx_provenance")
def provenance_iter(spark, sf):
    tool = F.when(F.col("line_no") % 10 != 0, F.struct(F.col("tool_name").alias("name"), F.col("tool_version").alias("version")))
    p = X.provenance(spark, sf).select("event_id", "actor", "action", tool.alias("tool"))
    return p.select("event_id", "actor", "action", F.coalesce("tool.name", F.lit("")).alias("tool_name"), F.coalesce("tool.version", F.lit("")).alias("tool_version"))


@query("scan_cross_root", "SELECT kind, id FROM (SELECT 'edge' AS kind, edge_id AS id FROM fx_edges WHERE parent_root_id <> child_root_id AND relation_type = 'references')")
def scan_cross_root(spark, sf):
    root = shared_dir(spark)
    e = X.edges(spark, sf).where("parent_root_id <> child_root_id AND relation_type = 'references'").select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"))
    body = e.agg(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "id")))).alias("value"))
    body.write.text(f"{root}/cross_root")
    return readers.document(spark, f"{root}/cross_root", "kind string, id string")


@query("scan_jobs", "SELECT 'job-' || r_regionkey AS job_id, CASE WHEN r_regionkey % 2 = 0 THEN 'keyword_search' ELSE 'yara_scan' END AS task, CAST(r_regionkey AS BIGINT) AS chunks FROM region WHERE r_regionkey <> 3")
def scan_jobs(spark, sf):
    root = shared_dir(spark)
    for r in X.read(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect():  # five documents
        k = r[0]
        body = "{broken" if k == 3 else job_document(f"job-{k}", "keyword_search" if k % 2 == 0 else "yara_scan", [f"c{i}" for i in range(k)])
        sinks.text_file(spark, f"{root}/jobs/job-{k}.json", body)
    return readers.jobs(spark, root, "job_id string, task string, scope struct<chunks:array<string>>").select("job_id", "task", F.size("scope.chunks").cast("long").alias("chunks"))


def job_document(job_id, task, chunks, created_at="2026-01-01T00:00:00Z", parameters=None, **more):
    """JSON of a job manifest."""
    import json

    return json.dumps({"job_id": job_id, "created_at": created_at, "case_id": "case-1", "task": task, "scope": {"chunks": chunks}, "tool": {"name": "tracelake", "version": "1.0.0"}, "parameters": parameters or {}, **more}, sort_keys=True)


@query("scan_delta_files", "SELECT job_dir, object_id, object_type FROM fx_deltas")
def scan_delta_files(spark, sf):
    from .q_aggregates import deltas

    root = shared_dir(spark)
    write_deltas(deltas(spark, sf), root)
    return readers.deltas(spark, root, "objects", "object_id string, object_type string").select("job_dir", "object_id", "object_type")


def write_deltas(rows, root):
    """One delta log a job: files of ordered ranges of its lines."""
    jobs = [r.job_dir for r in rows.select("job_dir").distinct().collect()]
    ranged = rows.select("job_dir", "object_id", "object_type", "line").repartitionByRange("job_dir", "line").sortWithinPartitions("line")
    for job in jobs:  # as many as there are jobs to merge
        sinks.append_log(ranged.where(F.col("job_dir") == job).drop("job_dir", "line"), f"{root}/analysis/jobs/{job}/objects_delta.jsonl")


@query("scan_manifest", "SELECT 'case-1' AS case_id, '0.2.0' AS version, 'block_image' AS acquisition_mode")
def scan_manifest(spark, sf):
    path = f"{shared_dir(spark)}/manifest.json"
    sinks.text_file(spark, path, '{\n "case_id": "case-1",\n "version": "0.2.0",\n "unknown": 1\n}')
    d = readers.document(spark, path, "case_id string, version string, acquisition_mode string")
    return d.select("case_id", "version", F.coalesce("acquisition_mode", F.lit("block_image")).alias("acquisition_mode"))


@query("scan_acquisition", "SELECT count(*) AS size_chunks, CAST(sum(source_length) AS BIGINT) AS source_bytes FROM fx_chunk_map")
def scan_acquisition(spark, sf):
    path = f"{shared_dir(spark)}/acquisition.json"
    n = X.chunk_map(spark, sf).agg(F.count(F.lit(1)).alias("size_chunks"), F.sum("source_length").alias("source_bytes")).select(F.to_json(F.struct("size_chunks", "source_bytes"))).first()[0]
    sinks.text_file(spark, path, n)
    return readers.document(spark, path, "size_chunks long, source_bytes long")


def chunk_container(spark, sf, root):
    """Chunks of all documents, half of them as zstd frames, with their map; one chunk's stored bytes are changed."""
    d = X.read(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("sequence")).select("sequence", F.col("text").cast("binary").alias("plain"))
    z = F.col("sequence") % 2 == 0
    rows = d.withColumn("packed", compress(F.col("plain"))).withColumns({"stored": F.when(z, F.col("packed")).otherwise(F.col("plain")), "compression": F.when(z, "zstd").otherwise("none")})
    rows = rows.select("sequence", "compression", F.sha2("plain", 256).alias("plaintext_sha256"), F.sha2("stored", 256).alias("stored_sha256"), "stored")
    rows = rows.withColumn("chunk_id", S.tagged(F.col("plaintext_sha256")))
    hurt = rows.withColumn("stored", F.when(F.col("sequence") == 60, F.concat(F.lit(b"!").cast("binary"), "stored")).otherwise(F.col("stored")))
    sinks.store_blobs(hurt.select(F.concat(F.lit("."), F.lit("/"), S.chunk_path(F.col("chunk_id"))).alias("path"), "stored"), root, "path", "stored").count()
    return rows.drop("stored")


@query("scan_blob_chunk", "SELECT CASE WHEN seq = 60 THEN 'stored_hash' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT min(doc_id) AS seq FROM documents GROUP BY text) GROUP BY 1")
def scan_blob_chunk(spark, sf):
    root = shared_dir(spark)
    chunks = chunk_container(spark, sf, root)
    return readers.read_chunks(spark, root, chunks).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _stored(spark, sf, path_fn):
    root = shared_dir(spark)
    d = X.read(spark, sf, "documents").select(path_fn(F.sha2("text", 256)).alias("path"), F.col("text").cast("binary").alias("content"))
    sinks.store_blobs(d, root, "path", "content").count()
    return root


_BLOB_SQL = "SELECT sha256(text) AS digest, min(CAST(octet_length(encode(text)) AS BIGINT)) AS size{0} FROM documents GROUP BY text"


@query("scan_evidence_object", _BLOB_SQL.format(", true AS ok"))
def scan_evidence_object(spark, sf):
    return readers.verified_blobs(spark, _stored(spark, sf, S.evidence_path), "evidence/objects").select("digest", "size", "ok")


@query("scan_derived_object", _BLOB_SQL.format(", true AS ok"))
def scan_derived_object(spark, sf):
    return readers.verified_blobs(spark, _stored(spark, sf, S.derived_path), "derived/objects").select("digest", "size", "ok")


@query("object_sha_compute", "SELECT DISTINCT sha256(text) AS digest, sha256(text) AS computed FROM documents")
def object_sha_compute(spark, sf):
    b = readers.blobs(spark, _stored(spark, sf, S.evidence_path), "evidence/objects")
    return b.select("digest", F.sha2("content", 256).alias("computed"))


@query("list_evidence_objects", _BLOB_SQL.format(""))
def list_evidence_objects(spark, sf):
    return readers.blobs(spark, _stored(spark, sf, S.evidence_path), "evidence/objects", content=False).select("digest", "size")


@query("scan_derived_streaming", "SELECT sha256(text) AS digest, CAST((octet_length(encode(text)) + 4095) // 4096 AS BIGINT) AS pieces FROM documents WHERE text <> '' GROUP BY text")
def scan_derived_streaming(spark, sf):
    """Pieces of 4096 bytes of each object; no task holds a whole object."""
    df = readers.pieces(spark, f"{_stored(spark, sf, S.derived_path)}/derived/objects", 4096)
    return df.groupBy(readers.digest_in(F.col("path")).alias("digest")).agg(F.count(F.lit(1)).alias("pieces"))


@query("list_artifacts", "SELECT 'analysis/jobs/job-' || r_regionkey || '/result.txt' AS key, CAST(length(r_name) AS BIGINT) AS size FROM region")
def list_artifacts(spark, sf):
    root = shared_dir(spark)
    for r in X.read(spark, sf, "region").collect():  # five files
        sinks.text_file(spark, f"{root}/analysis/jobs/job-{r.r_regionkey}/result.txt", r.r_name)
    return readers.artifacts(spark, root)


@query("uri_resolve", "SELECT * FROM (VALUES ('s3://bucket/a/b/', 's3a://bucket/a/b'), ('/data/case/', '/data/case'), ('file:///x', 'file:///x')) t(uri, path)")
def uri_resolve(spark, sf):
    return spark.createDataFrame([(u, readers.resolve_uri(u)) for u in ("s3://bucket/a/b/", "/data/case/", "file:///x")], "uri string, path string")


def entries_of(spark, sf):
    """(path, content) of all documents."""
    name = F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    return X.read(spark, sf, "documents").select(name.alias("path"), F.col("text").cast("binary").alias("content"))


def write_image(spark, sf, path):
    """A raw image, all documents in order of their ids; its digest."""
    return sinks.raw_export(X.read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "content", path, shared=True)


@query("packed_index", "SELECT path, 8 + CAST(coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, n AS length, digest AS sha256 FROM (SELECT 'docs/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS n, sha256(text) AS digest FROM documents)")
def packed_index(spark, sf):
    path = shared_dir(spark) + "/archive.pk"
    sinks.archive(entries_of(spark, sf), path)
    spark.dataSource.register(packed.PackedSource)
    return spark.read.format("packed_archive").load(path).select("path", "offset", "length", "sha256")


@query("unpack", "SELECT 'docs/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS path, sha256(text) AS digest, true AS ok FROM documents")
def unpack(spark, sf):
    path = shared_dir(spark) + "/archive.pk"
    sinks.archive(entries_of(spark, sf), path)
    spark.dataSource.register(packed.PackedSource)
    return spark.read.format("packed_archive").option("content", "true").load(path).select("path", F.sha2("content", 256).alias("digest"), (F.sha2("content", 256) == F.col("sha256")).alias("ok"))


@query("raw_image", "SELECT r AS sequence, r * 65536 AS source_offset, least(65536, n - r * 65536) AS source_length FROM (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS n FROM documents), range((SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) // 65536 + 1 FROM documents)) t(r) WHERE r * 65536 < n")
def raw_image(spark, sf):
    """Fixed-size chunks of a raw image: each task reads its own ranges."""
    path = shared_dir(spark) + "/image.raw"
    write_image(spark, sf, path)
    spark.dataSource.register(packed.RangeSource)
    df = spark.read.format("byte_ranges").option("piece", 65536).load(path)
    return df.select(F.col("piece").alias("sequence"), F.col("start").alias("source_offset"), F.octet_length("content").cast("long").alias("source_length"))


@query("convert", "SELECT count(*) AS chunks, CAST(sum(least(65536, n - r * 65536)) AS BIGINT) AS bytes, true AS same_hash FROM (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS n FROM documents), range((SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) // 65536 + 1 FROM documents)) t(r) WHERE r * 65536 < n")
def convert(spark, sf):
    """Image to chunk map: pieces are hashed where they are read, the whole digest is checked by a stream."""
    root = shared_dir(spark)
    path = f"{root}/image.raw"
    digest = write_image(spark, sf, path)
    spark.dataSource.register(packed.RangeSource)
    pieces = spark.read.format("byte_ranges").option("piece", 65536).load(path)
    h = F.sha2("content", 256)
    size = F.octet_length("content").cast("long")
    rows = pieces.select(F.col("piece").alias("sequence"), F.col("start").alias("source_offset"), size.alias("source_length"), S.tagged(h).alias("chunk_id"), size.alias("stored_length"), F.lit("none").alias("compression"), h.alias("plaintext_sha256"), h.alias("stored_sha256"))
    sinks.table(rows, f"{root}/indexes/physical_to_chunk.parquet", schemas.CHUNK_MAP, sort="sequence")
    same = sinks.stream_digest(pieces, "piece", "content") == digest
    return readers.chunk_map(spark, root).agg(F.count(F.lit(1)).alias("chunks"), F.sum("source_length").alias("bytes")).withColumn("same_hash", F.lit(same))


@query("export_csv", "SELECT child_object_id || ',' || string_agg(parent_object_id, '|' ORDER BY edge_id) AS line FROM fx_edges GROUP BY child_object_id")
def export_csv(spark, sf):
    return sinks.lineage_csv(X.edges(spark, sf))


@query("export_dot", r"""SELECT CAST(0 AS BIGINT) AS part, '    "' || object_id || '" [label="' || object_id || '\n' || coalesce(name, '') || '\n' || object_type || '"];' AS line FROM fx_objects UNION ALL SELECT 1, '    "' || parent_object_id || '" -> "' || child_object_id || '" [label="' || relation_type || '"];' FROM fx_edges""")
def export_dot(spark, sf):
    return sinks.lineage_dot(X.objects(spark, sf), X.edges(spark, sf)).withColumn("part", F.col("part").cast("long"))


@query("export_json", "SELECT part, count(*) AS rows FROM (SELECT 'objects' AS part FROM fx_objects UNION ALL SELECT 'edges' FROM fx_edges UNION ALL SELECT 'derivations' FROM fx_derivations) GROUP BY part")
def export_json(spark, sf):
    j = sinks.lineage_json(X.objects(spark, sf), X.edges(spark, sf), X.derivations(spark, sf))
    return j.where(F.try_parse_json("line").isNotNull()).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query("sink_analysis_rows", "SELECT doc_id, label FROM (SELECT CAST(substr(label_event_id, 5) AS BIGINT) AS doc_id, label FROM fx_label_events)")
def sink_analysis_rows(spark, sf):
    root = shared_dir(spark)
    path = sinks.write_once(X.label_events(spark, sf).select(F.substring("label_event_id", 5, 20).cast("long").alias("doc_id"), "label"), root, "job-1", "hits.jsonl")
    return readers.jsonl(spark, path, "doc_id long, label string")


_HITS = "SELECT 'hit-' || event_id AS hit_id, 'job-1' AS job_id, event_type AS {0}, event_id * 10 AS physical_offset FROM events"


@query("sink_keyword_hits", _HITS.format("keyword"))
def sink_keyword_hits(spark, sf):
    path = f"{shared_dir(spark)}/keyword_hits.parquet"
    e = X.read(spark, sf, "events").select(F.expr("concat('hit-', event_id) AS hit_id"), F.lit("job-1").alias("job_id"), F.col("event_type").alias("keyword"), F.lit("c").alias("chunk_id"), (F.col("event_id") * 10).alias("physical_offset"), *[F.lit("").alias(c) for c in ("file_id", "context_before", "context_after", "encoding", "worker_id", "timestamp")])
    sinks.table(e, path, schemas.KEYWORD_HITS)
    return readers.table(spark, path, schemas.KEYWORD_HITS).select("hit_id", "job_id", "keyword", "physical_offset")


@query("sink_yara_hits", _HITS.format("rule_name"))
def sink_yara_hits(spark, sf):
    path = f"{shared_dir(spark)}/yara_hits.parquet"
    e = X.read(spark, sf, "events").select(F.expr("concat('hit-', event_id) AS hit_id"), F.lit("job-1").alias("job_id"), F.col("event_type").alias("rule_name"), F.lit("h").alias("ruleset_hash"), F.lit("c").alias("chunk_id"), (F.col("event_id") * 10).alias("physical_offset"), F.lit(3).alias("match_length"), *[F.lit("").alias(c) for c in ("file_id", "worker_id", "timestamp")])
    sinks.table(e, path, schemas.YARA_HITS)
    return readers.table(spark, path, schemas.YARA_HITS).select("hit_id", "job_id", "rule_name", "physical_offset")


@query("result_manifest_build", "SELECT 'analysis/jobs/job-' || r_regionkey || '/result.txt' AS path, sha256(r_name) AS sha256, CAST(length(r_name) AS BIGINT) AS size FROM region WHERE r_regionkey < 3")
def result_manifest_build(spark, sf):
    """Listed artifacts that exist, with size and digest; absent ones are skipped."""
    root = shared_dir(spark)
    for r in X.read(spark, sf, "region").where("r_regionkey < 3").collect():
        sinks.text_file(spark, f"{root}/analysis/jobs/job-{r.r_regionkey}/result.txt", r.r_name)
    listed = spark.range(5).select(F.format_string("analysis/jobs/job-%d/result.txt", F.col("id")).alias("path"))
    files = readers.files(spark, f"{root}/analysis").select(F.regexp_extract("path", "/(analysis/.*)$", 1).alias("path"), "size", F.sha2("content", 256).alias("sha256"))
    return listed.join(files, "path").select("path", "sha256", "size")


@query("job_event_build", "SELECT 'job-' || r_regionkey AS job_id, 'analysis_job_completed' AS event_type, 'completed' AS status FROM region")
def job_event_build(spark, sf):
    return X.read(spark, sf, "region").select(F.expr("concat('job-', r_regionkey) AS job_id"), F.lit("analysis_job_completed").alias("event_type"), F.lit("completed").alias("status"))


@query("job_create", "SELECT 'job-' || r_regionkey AS job_id, CASE r_regionkey % 3 WHEN 0 THEN 'keyword_search' WHEN 1 THEN 'yara_scan' ELSE 'object_worker' END AS task, CAST(2 AS BIGINT) AS chunks FROM region")
def job_create(spark, sf):
    docs = [(job_document(f"job-{k}", ("keyword_search", "yara_scan", "object_worker")[k % 3], ["a", "b"]),) for k in range(5)]
    d = spark.createDataFrame(docs, "value string").select(F.from_json("value", "job_id string, task string, scope struct<chunks:array<string>>").alias("j"))
    return d.select("j.job_id", "j.task", F.size("j.scope.chunks").cast("long").alias("chunks"))
