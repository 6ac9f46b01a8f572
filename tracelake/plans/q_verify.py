"""Queries of verification, cases, scans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as K
from ..operators import replay as R
from ..operators import scan as N
from ..registry import RELATIONS, query
from ..sources import fixtures as X
from ..sources import readers, schemas, sinks
from ..sources.store import shared_dir, staged, stored
from ..streaming import replay as ST
from . import checks as V
from .q_joins import bad_leaves, live_edges, live_objects
from .q_jobs import shard_issues

_REPORT = "SELECT name, CASE WHEN n = 0 THEN 'pass' WHEN level = 'warn' THEN 'warning' ELSE 'fail' END AS status, CASE WHEN n = 0 THEN 'low' WHEN level = 'warn' THEN 'medium' ELSE 'high' END AS severity, n FROM ({0})"


def _report(rules):
    return V.report(rules).select("name", "status", "severity", "n")


def _rules(*items: tuple[str, str] | tuple[str, str, str]) -> str:
    return _REPORT.format(" UNION ALL ".join(f"SELECT '{i[0]}' AS name, '{i[2] if len(i) > 2 else 'fail'}' AS level, ({i[1]}) AS n" for i in items))


RELATIONS["fx_bad_chunks"] = "SELECT * REPLACE (CASE WHEN sequence % 50 = 7 THEN sha256('bad') ELSE plaintext_sha256 END AS plaintext_sha256) FROM fx_chunk_map"


def bad_chunks(spark, sf):
    return X.chunk_map(spark, sf).withColumn("plaintext_sha256", F.when(F.col("sequence") % 50 == 7, F.sha2(F.lit("bad"), 256)).otherwise(F.col("plaintext_sha256")))


def _core_sql(level, chunks, leaves):
    return _rules(
        ("mapping gaps", f"SELECT count(*) FROM {chunks} a JOIN {chunks} b ON b.sequence = a.sequence + 1 WHERE b.source_offset <> a.source_offset + a.source_length", level),
        ("chunk id is the plaintext hash", f"SELECT count(*) FROM {chunks} WHERE replace(chunk_id, 'sha256:', '') <> plaintext_sha256"),
        ("stored equals plain without compression", f"SELECT count(*) FROM {chunks} WHERE stored_sha256 <> plaintext_sha256 OR stored_length <> source_length"),
        ("unknown compression", "SELECT 0"),
        ("leaves match mapping", f"SELECT count(*) FROM {chunks} c FULL JOIN {leaves} l ON c.sequence = l.sequence WHERE c.plaintext_sha256 IS DISTINCT FROM l.plaintext_sha256", level),
        ("sequence repeats", "SELECT 0"),
    )


RELATIONS["fx_subset"] = "SELECT * FROM fx_chunk_map WHERE sequence % 3 = 0 OR sequence % 5 = 0"


@query("verify_core", _core_sql("fail", "fx_bad_chunks", "fx_bad_leaves"))
def verify_core(spark, sf):
    return _report(V.core(*staged(bad_chunks(spark, sf), bad_leaves(spark, sf))))


@query("verify_subset", _core_sql("warn", "fx_subset", "fx_leaves"))
def verify_subset(spark, sf):
    return _report(V.core(X.chunk_map(spark, sf).where("sequence % 3 = 0 OR sequence % 5 = 0"), X.leaves(spark, sf), subset=True))


RELATIONS["fx_bad_provenance"] = "SELECT line_no, CASE line_no WHEN 100 THEN 'evt-000050' WHEN 200 THEN 'evt-000001x' WHEN 250 THEN 'evt-000007' ELSE event_id END AS event_id, CASE WHEN line_no = 300 THEN ' ' ELSE actor END AS actor, action, tool_name, tool_version FROM fx_provenance"


def bad_provenance(spark, sf):
    n = F.col("line_no")
    e = F.when(n == 100, "evt-000050").when(n == 200, "evt-000001x").when(n == 250, "evt-000007").otherwise(F.col("event_id"))
    return X.provenance(spark, sf).withColumns({"event_id": e, "actor": F.when(n == 300, " ").otherwise(F.col("actor"))})


_PROV = "SELECT line_no, CASE WHEN line_no > first THEN 'repeated event_id' WHEN trim(actor) = '' THEN 'actor' WHEN number < before THEN 'number falls' END AS problem FROM (SELECT *, min(line_no) OVER (PARTITION BY event_id) AS first, lag(number) OVER (ORDER BY line_no) AS before FROM (SELECT *, TRY_CAST(regexp_extract(event_id, '^evt-([0-9]+)$', 1) AS BIGINT) AS number FROM fx_bad_provenance))"


@query("verify_provenance", f"SELECT line_no, problem FROM ({_PROV}) WHERE problem IS NOT NULL ORDER BY line_no LIMIT 1")
def verify_provenance(spark, sf):
    return V.provenance(bad_provenance(spark, sf))


@query("verify_provenance_all", f"SELECT line_no, problem FROM ({_PROV}) WHERE problem IS NOT NULL")
def verify_provenance_all(spark, sf):
    return V.provenance(bad_provenance(spark, sf), first_only=False)


@query("verify_extensions", "SELECT CAST(doc_id AS BIGINT) + 1 AS line_no, 'missing label' AS problem FROM labels WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id + 1, 'missing target' FROM labels WHERE doc_id % 9 = 3")
def verify_extensions(spark, sf):
    """Records without a required key; an empty string is a value."""
    d = F.col("doc_id")
    label = F.when(d % 9 == 0, F.lit(None)).when(d % 9 == 1, "").otherwise("x")
    target = F.when(d % 9 != 3, F.struct(F.lit("object").alias("type"), F.lit("o").alias("id")))
    lines = X.read(spark, sf, "labels").select((d + 1).alias("line_no"), F.to_json(F.struct(F.lit("l").alias("label_event_id"), F.lit("").alias("timestamp"), F.lit("a").alias("actor"), target.alias("target"), label.alias("label"))).alias("value"))
    from ..sources.schemas import REQUIRED_KEYS

    return V.missing_keys(lines, REQUIRED_KEYS["labels"])


def _graph_counts():
    names = {"missing_edge_parent": "edge parents exist", "missing_edge_child": "edge children exist", "missing_derivation_parent": "derivation parents exist", "missing_derivation_child": "derivation children exist"}
    return [(text, f"SELECT count(*) FROM fx_graph_issues WHERE rule = '{rule}'") for rule, text in names.items()]


@query("verify_objects", _rules(("object ids are unique", "SELECT 0"), ("hash status is known", "SELECT count(*) FROM fx_live_objects WHERE CAST(substr(object_id, 2) AS BIGINT) % 71 = 0"), ("files have a parent", "SELECT count(*) FROM fx_live_objects WHERE object_type = 'file' AND object_id NOT IN (SELECT child_object_id FROM fx_live_edges WHERE relation_type = 'contains')"), *_graph_counts()))
def verify_objects(spark, sf):
    o = live_objects(spark, sf).withColumn("content_hash_status", F.when(F.substring("object_id", 2, 20).cast("long") % 71 == 0, "odd").otherwise("verified"))
    return _report(V.objects(*staged(o, live_edges(spark, sf), X.derivations(spark, sf))))


@query("verify_lineage", _rules(*_graph_counts(), ("derivations have an edge", "SELECT count(*) FROM fx_graph_issues WHERE rule = 'derivation_without_edge'"), ("derivation hashes", "SELECT count(*) FROM fx_derivations d JOIN fx_live_objects o ON o.object_id = parent_object_id WHERE input_sha256 <> o.sha256"), ("derivation hashes are given", "SELECT (SELECT count(*) FROM fx_derivations d LEFT JOIN fx_live_objects o ON o.object_id = parent_object_id WHERE input_sha256 IS NULL OR o.sha256 IS NULL) + (SELECT count(*) FROM fx_derivations d LEFT JOIN fx_live_objects o ON o.object_id = child_object_id WHERE o.sha256 IS NULL)", "warn")))
def verify_lineage(spark, sf):
    return _report(V.lineage(*staged(live_objects(spark, sf), live_edges(spark, sf), X.derivations(spark, sf))))


@query("verify_parallel", _rules(*[(k.replace("_", " "), f"SELECT count(*) FROM fx_shard_issues WHERE kind = '{k}'") for k in ("missing_shard_manifest", "missing_result", "scope_hash_mismatch", "artifact_unreadable", "artifact_hash_mismatch", "duplicate_input")]))
def verify_parallel(spark, sf):
    return _report(V.parallel(stored(shard_issues(spark, sf), shared_dir(spark))))


@query("verify_collection", _rules(("collection has roots", "SELECT 0"), ("limitations", "SELECT 2", "warn"), ("root objects are indexed", "SELECT count(*) FROM fx_roots WHERE replace(root_id, 'root-', 'r') NOT IN (SELECT object_id FROM fx_live_objects)"), ("object ids are unique", "SELECT 0")))
def verify_collection(spark, sf):
    r = X.roots(spark, sf).withColumn("root_object", F.replace("root_id", F.lit("root-"), F.lit("r")))
    return _report(V.collection(r, live_objects(spark, sf), 2))


@query("verify_case", _rules(("root ids are unique", "SELECT 0"), ("root reference is known", "SELECT 0"), ("roots are attached", "SELECT count(*) FROM fx_roots WHERE status <> 'active'", "warn"), ("roots are online", "SELECT count(*) FROM fx_roots WHERE availability <> 'online'", "warn"), ("objects have a known root", "SELECT count(*) FROM fx_objects WHERE root_id IS NULL")))
def verify_case(spark, sf):
    return _report(V.case(X.roots(spark, sf), X.objects(spark, sf), "full"))


@query("verify_legacy", _rules(("results have worker", "SELECT count(*) FROM events WHERE event_id % 100 = 0", "warn")))
def verify_legacy(spark, sf):
    """Old flat result rows: a missing field is a warning."""
    rows = X.read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 100 != 0, F.lit("w")).alias("worker"))
    return _report([V.rule("results have worker", rows.where("worker IS NULL"), "event_id", "warn")])


@query("report_json", "SELECT 'fail' AS overall_status, CAST(6 AS BIGINT) AS checks")
def report_json(spark, sf):
    c = V.report(V.core(*staged(bad_chunks(spark, sf), bad_leaves(spark, sf)))).withColumn("message", F.coalesce("example", F.lit("")))
    d = sinks.report_json(c)
    return d.select(F.get_json_object("document", "$.overall_status").alias("overall_status"), F.size(F.from_json(F.get_json_object("document", "$.checks"), "array<struct<id:string>>")).cast("long").alias("checks"))


@query("report_md", "SELECT CAST(8 AS BIGINT) AS lines")
def report_md(spark, sf):
    c = V.report(V.core(*staged(bad_chunks(spark, sf), bad_leaves(spark, sf)))).withColumn("message", F.coalesce("example", F.lit("")))
    return spark.createDataFrame([(len(sinks.report_markdown(c).strip().split("\n")),)], "lines long")


@query("coverage_print", "SELECT name, v FROM (SELECT CAST(sum(assigned) AS BIGINT) AS assigned, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(success) AS BIGINT) AS success, CAST(sum(error) AS BIGINT) AS error, CAST(sum(skipped) AS BIGINT) AS skipped FROM fx_results) UNPIVOT (v FOR name IN (assigned, processed, success, error, skipped))")
def coverage_print(spark, sf):
    from .q_jobs import agg_coverage

    c = agg_coverage(spark, sf).drop("in_scope")
    return c.unpivot([], [F.col(x).cast("long").alias(x) for x in c.columns], "name", "v")


@query("conformance", "SELECT profile, path, present FROM (VALUES ('reader', 'manifest.json', true), ('reader', 'acquisition.json', false), ('reader', 'indexes/physical_to_chunk.parquet', true), ('analysis', 'manifest.json', true), ('analysis', 'analysis', true), ('indexer', 'manifest.json', true), ('indexer', 'indexes/partitions/partition_table.json', false), ('indexer', 'indexes/objects/object_index.parquet', true), ('acquisition', 'manifest.json', true), ('acquisition', 'acquisition.json', false), ('acquisition', 'integrity/leaves.parquet', false), ('acquisition', 'provenance/chain_of_custody.jsonl', false)) t(profile, path, present)")
def conformance(spark, sf):
    files = spark.createDataFrame([("manifest.json",), ("indexes/physical_to_chunk.parquet",), ("indexes/objects/object_index.parquet",), ("analysis/jobs/j/r.json",)], "path string")
    out = None
    for p in V.PROFILES:
        part = V.conformance(spark, files, p).select(F.lit(p).alias("profile"), "path", "present")
        out = part if out is None else out.union(part)
    return out


@query("root_descriptor", "SELECT root_id, CASE WHEN root_id = 'root-2' THEN 'hash_mismatch' WHEN root_id = 'root-4' THEN 'missing_manifest' ELSE 'ok' END AS outcome FROM fx_roots")
def root_descriptor(spark, sf):
    r = X.roots(spark, sf)
    have = r.where("root_id <> 'root-4'").select("root_id", F.sha2("name", 256).alias("actual"))
    want = r.select("root_id", F.when(F.col("root_id") == "root-2", F.lit("x")).otherwise(F.sha2("name", 256)).alias("expected"))
    j = want.join(have, "root_id", "left")
    return j.select("root_id", F.when(F.col("actual").isNull(), "missing_manifest").when(F.col("actual") != F.col("expected"), "hash_mismatch").otherwise("ok").alias("outcome"))


@query("migrate", "SELECT '0.2.0' AS version, 'block_image' AS acquisition_mode, (SELECT count(*) FROM fx_chunk_map) AS chunks, true AS unchanged")
def migrate(spark, sf):
    """Manifest of the old version rewritten; the chunk table keeps its rows."""
    c, root = X.chunk_map(spark, sf).drop("doc_id"), shared_dir(spark)
    sinks.table(c, f"{root}/old.parquet", schemas.CHUNK_MAP, sort="sequence")
    before = readers.table(spark, f"{root}/old.parquet", schemas.CHUNK_MAP)
    sinks.table(before, f"{root}/new.parquet", schemas.CHUNK_MAP, sort="sequence")
    after = readers.table(spark, f"{root}/new.parquet", schemas.CHUNK_MAP)
    old = spark.createDataFrame([("0.1.0", None)], "version string, acquisition_mode string")
    new = old.select(F.when(F.col("version") == "0.1.0", "0.2.0").otherwise(F.col("version")).alias("version"), F.coalesce("acquisition_mode", F.lit("block_image")).alias("acquisition_mode"))
    return new.join(F.broadcast(c.agg(F.count(F.lit(1)).alias("chunks"))), F.lit(True)).withColumn("unchanged", F.lit(R.same_rows(before, after)))  # one row with one row


@query("sdk_verify", "SELECT true AS \"schema\", true AS source, true AS merkle")
def sdk_verify(spark, sf):
    from ..operators import merkle as M

    map_, leaves = X.chunk_map(spark, sf), X.leaves(spark, sf)
    text = X.read(spark, sf, "documents").join(map_.select("doc_id", "sequence"), "doc_id").select("sequence", F.col("text").cast("binary").alias("b"))
    whole = sinks.raw_export(text, "sequence", "b", f"{shared_dir(spark)}/source.raw", shared=True)
    nodes = M.tree(leaves)
    top = nodes.orderBy(F.desc("level")).limit(1).first().h
    ok = (set(("sequence", "chunk_id")) <= set(map_.columns), sinks.stream_digest(text, "sequence", "b") == whole, M.root(leaves).first().root == top and not M.invalid_nodes(nodes).limit(1).count())
    return spark.createDataFrame([ok], "schema boolean, source boolean, merkle boolean")


@query("schema_validate", "SELECT event_id AS row_id, 'tool.name' AS path, 'required' AS message FROM events WHERE event_id % 10 = 3 UNION ALL SELECT event_id, 'event_id', 'pattern' FROM events WHERE event_id % 10 = 4 UNION ALL SELECT event_id, 'action', 'enum' FROM events WHERE event_type = 'error'")
def schema_validate(spark, sf):
    i = F.col("event_id")
    tool = F.when(i % 10 != 3, F.struct(F.lit("t").alias("name")))
    eid = F.when(i % 10 == 4, "bad").otherwise(F.format_string("evt-%06d", i))
    rows = X.read(spark, sf, "events").select(i.alias("row_id"), F.to_json(F.struct(eid.alias("event_id"), F.col("event_type").alias("action"), tool.alias("tool"))).alias("value"))
    return V.documents(rows, [("tool.name", "required", ""), ("event_id", "pattern", "^evt-[0-9]{6,}$"), ("action", "enum", ("view", "click", "purchase", "signup"))])


@query("annotation_log", "SELECT annotation_id, label FROM (SELECT 'ann-' || doc_id AS annotation_id, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS label, doc_id FROM labels) a WHERE NOT EXISTS (SELECT 1 FROM labels c WHERE c.doc_id % 4 = 0 AND c.doc_id = a.doc_id + 1 AND c.doc_id - 1 IN (SELECT doc_id FROM labels))")
def annotation_log(spark, sf):
    """Annotations that no later one corrects."""
    d = X.read(spark, sf, "labels")
    a = d.select(F.expr("concat('ann-', doc_id)").alias("annotation_id"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("label"), F.when(F.col("doc_id") % 4 == 0, F.expr("concat('ann-', doc_id - 1)")).alias("correction_of"))
    return a.join(a.where("correction_of IS NOT NULL").select(F.col("correction_of").alias("annotation_id")), "annotation_id", "left_anti").select("annotation_id", "label")


@query("access_log", "SELECT 'access-' || lpad(CAST(row_number() OVER (ORDER BY access_event_id) AS VARCHAR), 6, '0') AS id, access_event_id AS source, actor FROM fx_access_events WHERE NOT is_denied")
def access_log(spark, sf):
    from pyspark.sql import Window

    a = X.access_events(spark, sf).where("NOT is_denied")
    n = F.row_number().over(Window.orderBy("access_event_id"))
    return a.select(F.format_string("access-%06d", n).alias("id"), F.col("access_event_id").alias("source"), "actor")


@query("denied_log", "SELECT access_event_id AS id, actor, 'read' AS kind FROM fx_access_events WHERE is_denied UNION ALL SELECT 'w-' || access_event_id, actor, 'write' FROM fx_access_events WHERE NOT is_denied AND actor = 'user'")
def denied_log(spark, sf):
    """Denied reads and writes have different records in one log."""
    a = X.access_events(spark, sf)
    reads = a.where("is_denied").select(F.col("access_event_id").alias("denied_event_id"), "actor")
    writes = a.where("NOT is_denied AND actor = 'user'").select(F.concat(F.lit("w-"), "access_event_id").alias("event_id"), "actor", F.lit("write").alias("operation"))
    both = reads.unionByName(writes, allowMissingColumns=True)
    return both.select(F.coalesce("denied_event_id", "event_id").alias("id"), "actor", F.coalesce("operation", F.lit("read")).alias("kind"))


@query("case_create", "SELECT 'root_count' AS problem, '6' AS id UNION ALL SELECT 'repeated_root', 'root-1' UNION ALL SELECT 'case_id', 'case-2'")
def case_create(spark, sf):
    r = X.roots(spark, sf)
    return K.registry_problems(r.union(r.where("root_id = 'root-1'")), "case-1", "case-2", 5)


@query("case_validate_registry", "SELECT 'none' AS problem, 'none' AS id WHERE false")
def case_validate_registry(spark, sf):
    return K.registry_problems(X.roots(spark, sf), "case-1", "case-1", 5)


@query("case_list_roots", "SELECT root_id, status FROM fx_roots ORDER BY root_id")
def case_list_roots(spark, sf):
    return X.roots(spark, sf).select("root_id", "status").orderBy("root_id")


@query("case_attach_root", "SELECT root_id, status, name FROM fx_roots UNION ALL SELECT 'root-9', 'active', 'NEW'")
def case_attach_root(spark, sf):
    return K.attach(X.roots(spark, sf), "root-9", name="NEW", ref_type="relative").select("root_id", "status", "name")


@query("case_detach_root", "SELECT root_id, CASE WHEN root_id = 'root-1' THEN 'detached' ELSE status END AS status FROM fx_roots")
def case_detach_root(spark, sf):
    return K.detach(X.roots(spark, sf), "root-1").select("root_id", "status")


@query("case_resolve_root", "SELECT root_id, CASE ref_type WHEN 'embedded' THEN '/base' WHEN 'relative' THEN '/base/' || name WHEN 'absolute' THEN '/' || name ELSE name END AS path FROM fx_roots")
def case_resolve_root(spark, sf):
    return X.roots(spark, sf).select("root_id", K.location("/base").alias("path"))


@query("case_index_status", "SELECT root_id, CASE WHEN status <> 'active' THEN 'skipped_inactive' WHEN availability <> 'online' THEN 'skipped_unavailable' WHEN root_id = 'root-1' THEN 'skipped_missing_object_index' ELSE 'included' END AS index_status FROM fx_roots")
def case_index_status(spark, sf):
    return X.roots(spark, sf).select("root_id", K.index_status(F.col("root_id") != "root-1").alias("index_status"))


@query("case_event_id", "SELECT event_id, 'case-evt-' || lpad(CAST(event_id + 1 AS VARCHAR), 6, '0') AS id FROM events")
def case_event_id(spark, sf):
    return X.read(spark, sf, "events").select("event_id", K.event_id(F.col("event_id") + 1).alias("id"))


@query("root_infer", "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'root-0' ELSE 'root-' || r_regionkey END AS root_id, CASE WHEN r_regionkey = 0 THEN 'block_image' ELSE 'files' END AS root_type FROM region")
def root_infer(spark, sf):
    r = X.read(spark, sf, "region")
    one = F.array(F.struct(F.expr("concat('root-', r_regionkey)").alias("root_id"), F.lit("files").alias("root_type")))
    c = r.select("r_regionkey", F.when(F.col("r_regionkey") > 0, one).otherwise(F.filter(one, lambda x: F.lit(False))).alias("roots"), F.lit(None).cast("string").alias("acquisition_mode"))
    i, t = K.inferred_root()
    return c.select("r_regionkey", i.alias("root_id"), t.alias("root_type"))


KEYWORDS = ["license", "hehely", "Licensed under"]


def _stream(spark, sf):
    t = X.read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return X.chunk_map(spark, sf).select("doc_id", "sequence", "source_offset", "chunk_id").join(t, "doc_id")


@query("keyword_scan", "SELECT keyword, sequence, source_offset + pos AS physical_offset FROM (SELECT doc_id, keyword, CAST(list_sum(list_transform(parts[1:i], lambda x: CAST(octet_length(encode(x)) AS BIGINT))) + (i - 1) * length(keyword) AS BIGINT) AS pos FROM (SELECT doc_id, keyword, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, keyword, string_split(text, keyword) AS parts FROM documents, (VALUES ('license'), ('hehely'), ('Licensed under')) k(keyword) WHERE contains(text, keyword)))) h JOIN fx_chunk_map c ON c.doc_id = h.doc_id")
def keyword_scan(spark, sf):
    hits = N.keyword_hits(_stream(spark, sf), KEYWORDS, ("utf-8",))
    return hits.select("keyword", "sequence", "physical_offset")


@query("keyword_offsets", "SELECT doc_id, CAST(list_sum(list_transform(parts[1:i], lambda x: CAST(octet_length(encode(x)) AS BIGINT))) + (i - 1) * 6 AS BIGINT) AS byte_offset FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, 'hehely') AS parts FROM documents WHERE contains(text, 'hehely')))")
def keyword_offsets(spark, sf):
    t = X.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return N.keyword_offsets(t, "hehely").select(F.col("id").alias("doc_id"), F.col("byte_offset").cast("long").alias("byte_offset"))


RULES = """
rule mail {
  strings:
    $a = /[a-z0-9.]+@mail[0-9]\\.example/
  condition: any of them
}
rule licence {
  strings:
    $a = "LICENSED under" nocase
    $b = "apache" nocase
  condition: $a and $b
}
rule token {
  strings:
    $a = { 74 6f 6b 65 6e 20 3d }
  condition: any of them
}
rule everything {
  condition: true
}
"""


@query("yara_scan", "SELECT rule_name, count(*) AS chunks FROM (SELECT 'mail' AS rule_name FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@mail[0-9]\\.example') UNION ALL SELECT 'licence' FROM documents WHERE contains(lower(text), 'licensed under') AND contains(lower(text), 'apache') UNION ALL SELECT 'token' FROM documents WHERE contains(text, 'token =') UNION ALL SELECT 'everything' FROM documents) GROUP BY rule_name")
def yara_scan(spark, sf):
    hits = N.rule_hits(_stream(spark, sf), N.compile_rules(RULES), "h")
    return hits.groupBy("rule_name").agg(F.count_distinct("sequence").alias("chunks"))


@query("replay_streaming", "SELECT object_id, event_type, payload_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) AS r FROM fx_object_events WHERE event_type = 'removed' OR (event_type IN ('discovered', 'updated') AND payload_value IS NOT NULL)) WHERE r = 1 AND event_type <> 'removed'")
def replay_streaming(spark, sf):
    base = shared_dir(spark)
    X.object_events(spark, sf).repartitionByRange(3, "seq").write.json(f"{base}/log")
    ST.run(spark, f"{base}/log", "seq long, object_id string, event_type string, payload_value double", f"{base}/state", f"{base}/checkpoint")
    return ST.live(spark, f"{base}/state").select("object_id", "event_type", "payload_value", "seq")


@query("replay_log_files", "SELECT count(*) AS live FROM (SELECT event_type, row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) AS r FROM fx_object_events WHERE event_type = 'removed' OR (event_type IN ('discovered', 'updated') AND payload_value IS NOT NULL)) WHERE r = 1 AND event_type <> 'removed'")
def replay_log_files(spark, sf):
    """The same replay from JSON lines whose order is the files' and lines'."""
    base = shared_dir(spark)
    sinks.append_ordered(X.object_events(spark, sf), f"{base}/log", "seq")
    log = readers.ordered_log(spark, f"{base}/log", "object_id string, event_type string, payload_value double")
    return R.replay_objects(log).agg(F.count(F.lit(1)).alias("live"))
