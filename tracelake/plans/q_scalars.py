"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..registry import query
from ..sources import fixtures as X


@query("fn_sha256_hex", "SELECT doc_id, sha256(text) AS digest, 'sha256:' || sha256(text) AS tagged, sha256(text) AS bare FROM documents")
def fn_sha256_hex(spark, sf):
    h = S.sha256_hex(F.col("text"))
    return X.read(spark, sf, "documents").select("doc_id", h.alias("digest"), S.tagged(h).alias("tagged"), S.bare(S.tagged(h)).alias("bare"))


for _name, _fn, _store, _suffix in (("fn_chunk_path", S.chunk_path, "chunks", ".chunk"), ("fn_evidence_path", S.evidence_path, "evidence/objects", ".bin"), ("fn_derived_path", S.derived_path, "derived/objects", ".bin")):

    @query(_name, f"SELECT sequence, '{_store}/' || substr(plaintext_sha256, 1, 2) || '/' || substr(plaintext_sha256, 3, 2) || '/' || plaintext_sha256 || '{_suffix}' AS path FROM fx_chunk_map")
    def _cas(spark, sf, fn=_fn):
        return X.chunk_map(spark, sf).select("sequence", fn(F.col("chunk_id")).alias("path"))


@query("fn_object_id", "SELECT file_id, 'obj-fsfile-' || substr(sha256(partition_id || '|' || file_id || '|' || path), 1, 24) AS object_id FROM fx_file_index")
def fn_object_id(spark, sf):
    return X.file_index(spark, sf).select("file_id", S.object_id(F.col("partition_id"), F.col("file_id"), F.col("path")).alias("object_id"))


@query("fn_edge_id", "SELECT edge_id, parent_object_id, child_object_id, relation_type FROM fx_edges")
def fn_edge_id(spark, sf):
    e = X.edge_pairs(spark, sf)
    return e.select(S.edge_id(*[F.col(c) for c in ("parent_object_id", "child_object_id", "relation_type")]).alias("edge_id"), "parent_object_id", "child_object_id", "relation_type")


@query("fn_derivation_id", "SELECT derivation_id, parent_object_id, child_object_id FROM fx_derivations")
def fn_derivation_id(spark, sf):
    return X.derivations(spark, sf).select("derivation_id", "parent_object_id", "child_object_id")


@query("fn_collect_object_id", "SELECT 'obj-' || substr(sha256(text), 1, 16) AS object_id, count(*) AS files FROM documents GROUP BY 1")
def fn_collect_object_id(spark, sf):
    oid = S.collect_object_id(S.tagged(F.sha2("text", 256)))
    return X.read(spark, sf, "documents").groupBy(oid.alias("object_id")).agg(F.count(F.lit(1)).alias("files"))


@query("fn_normalize_path", r"SELECT file_id, '/' || path AS a, '/' || partition_id || '/' || filename AS b, '/' || path AS c FROM fx_file_index")
def fn_normalize_path(spark, sf):
    p = F.col("path")
    back = F.concat("partition_id", F.lit("\\"), "filename")
    return X.file_index(spark, sf).select("file_id", S.normalize_path(p).alias("a"), S.normalize_path(back).alias("b"), S.normalize_path(F.concat(F.lit("/"), p)).alias("c"))


@query("fn_extension", "SELECT object_id, CASE WHEN name IS NOT NULL THEN lower(split_part(name, '.', 2)) ELSE split_part(logical_path, '.', -1) END AS extension, CAST(NULL AS VARCHAR) AS dotfile, CAST(NULL AS VARCHAR) AS none FROM fx_doc_objects")
def fn_extension(spark, sf):
    none = F.lit(None).cast("string")
    dotted = F.concat(F.lit("a.b/."), F.col("object_id"))
    return X.doc_objects(spark, sf).select("object_id", S.extension_scope(F.col("name"), F.col("logical_path")).alias("extension"), S.extension_scope(none, dotted).alias("dotfile"), S.extension_scope(F.col("object_id"), F.col("logical_path")).alias("none"))


@query("fn_extension_ntfs", "SELECT file_id, CASE WHEN is_directory THEN '' ELSE extension END AS extension, CASE WHEN is_directory THEN '' ELSE 'gitignore' END AS dotfile FROM fx_file_index")
def fn_extension_ntfs(spark, sf):
    d = F.col("is_directory")
    return X.file_index(spark, sf).select("file_id", S.extension_index(F.col("filename"), d).alias("extension"), S.extension_index(F.lit(".gitignore"), d).alias("dotfile"))


@query("fn_replay_id", "SELECT event_id, 'sha256:' || sha256('case-1|job-' || user_id || '|' || event_type || '|' || props) AS replay_id FROM events")
def fn_replay_id(spark, sf):
    return X.read(spark, sf, "events").select("event_id", S.replay_id(F.lit("case-1"), F.concat(F.lit("job-"), F.col("user_id").cast("string")), F.col("event_type"), F.col("props")).alias("replay_id"))


@query("fn_check_slug", "SELECT p_partkey, 'check-' || CASE WHEN p_partkey % 200 < 10 THEN '00' WHEN p_partkey % 200 < 100 THEN '0' ELSE '' END || (p_partkey % 200) || '-' || trim(regexp_replace(lower('  ' || p_type || '/' || p_name || '! '), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def fn_check_slug(spark, sf):
    name = F.concat(F.lit("  "), "p_type", F.lit("/"), "p_name", F.lit("! "))
    return X.read(spark, sf, "part").select("p_partkey", S.check_slug((F.col("p_partkey") % 200).cast("int"), name).alias("slug"))


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'warn' ELSE 'fail' END"


@query("fn_status_map", f"SELECT s AS status, CASE s WHEN 'ok' THEN 'pass' WHEN 'warn' THEN 'warning' ELSE 'fail' END AS name, CASE s WHEN 'ok' THEN 'low' WHEN 'warn' THEN 'medium' ELSE 'high' END AS severity, count(*) AS n FROM (SELECT {_STATUS} AS s FROM orders) GROUP BY s")
def fn_status_map(spark, sf):
    s = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "warn").otherwise("fail")
    return X.read(spark, sf, "orders").select(s.alias("status")).groupBy("status", S.status_name(F.col("status")).alias("name"), S.severity(F.col("status")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_filetime", "SELECT event_id, CASE WHEN ft >= 116444736000000000 THEN (ft - 116444736000000000) // 10 END AS micros FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 10 = 1 THEN 116444735990000000 ELSE 134116992000000000 + event_id * 1234567 END AS ft FROM events)")
def fn_filetime(spark, sf):
    i = F.col("event_id")
    ft = F.when(i % 10 == 0, 0).when(i % 10 == 1, F.lit(116444735990000000)).otherwise(F.lit(134116992000000000) + i * 1234567)
    return X.read(spark, sf, "events").select("event_id", S.filetime_micros(ft.cast("long")).alias("micros"))


@query("fn_attr_flags", "SELECT p_partkey, (p_partkey * 37 & 512) <> 0 AS is_sparse, (p_partkey * 37 & 2048) <> 0 AS is_compressed, (p_partkey * 37 & 16384) <> 0 AS is_encrypted FROM part")
def fn_attr_flags(spark, sf):
    a, b, c = S.attr_flags(F.col("p_partkey") * 37)
    return X.read(spark, sf, "part").select("p_partkey", a.alias("is_sparse"), b.alias("is_compressed"), c.alias("is_encrypted"))


@query("fn_crc32")
def fn_crc32(spark, sf):
    return X.read(spark, sf, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


_HEX = "substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 32)"


def _pick(*at: int) -> str:
    return " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in at)


@query("fn_guid", f"SELECT n_nationkey, {_pick(3, 2, 1, 0)} || '-' || {_pick(5, 4)} || '-' || {_pick(7, 6)} || '-' || {_pick(8, 9)} || '-' || {_pick(10, 11, 12, 13, 14, 15)} AS guid FROM (SELECT n_nationkey, {_HEX} AS h FROM nation)")
def fn_guid(spark, sf):
    raw = F.unhex(F.substring(F.sha2(F.col("n_nationkey").cast("string"), 256), 1, 32))
    return X.read(spark, sf, "nation").select("n_nationkey", S.guid_text(raw).alias("guid"))


@query("fn_utf16le", "SELECT n_nationkey, n_name AS name FROM nation")
def fn_utf16le(spark, sf):
    raw = F.encode(F.concat("n_name", F.lit("\u0000tail")), "UTF-16LE")
    return X.read(spark, sf, "nation").select("n_nationkey", S.utf16_text(raw).alias("name"))


_MBR = "CASE t " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.MBR_TYPES.items()) + " ELSE 'Unknown' END"


@query("fn_part_type", f"SELECT t AS code, {_MBR} AS name, count(*) AS n FROM (SELECT CAST(p_partkey % 256 AS BIGINT) AS t FROM part) GROUP BY t")
def fn_part_type(spark, sf):
    return X.read(spark, sf, "part").select((F.col("p_partkey") % 256).alias("code")).groupBy("code", S.part_type(F.col("code")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


_GUIDS = list(S.TYPE_GUIDS)
_GUID_LIST = "[" + ", ".join(f"'{g}'" for g in [*_GUIDS, "00000000-0000-0000-0000-000000000000"]) + "]"
_GUID_CASE = "CASE g " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TYPE_GUIDS.items()) + " ELSE 'Unknown' END"


@query("fn_type_guid", f"SELECT n_nationkey, {_GUID_CASE} AS name FROM (SELECT n_nationkey, {_GUID_LIST}[n_nationkey % 11 + 1] AS g FROM nation)")
def fn_type_guid(spark, sf):
    g = F.element_at(F.array(*[F.lit(x.upper()) for x in [*_GUIDS, "00000000-0000-0000-0000-000000000000"]]), F.col("n_nationkey") % 11 + 1)
    return X.read(spark, sf, "nation").select("n_nationkey", S.type_guid(g).alias("name"))


@query("fn_parse_size", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS BIGINT) * 1024 WHEN 1 THEN CAST(p_size AS BIGINT) * 1048576 WHEN 2 THEN CAST(p_size AS BIGINT) * 1073741824 WHEN 3 THEN CAST(p_size AS BIGINT) END AS bytes FROM part")
def fn_parse_size(spark, sf):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("K", "m", "G", "", "X")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return X.read(spark, sf, "part").select("p_partkey", S.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("fn_csv_escape", """SELECT event_id, CASE WHEN regexp_matches(props, '[,"\n\r]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS quoted, event_type AS plain FROM events""")
def fn_csv_escape(spark, sf):
    return X.read(spark, sf, "events").select("event_id", S.csv_escape(F.col("props")).alias("quoted"), S.csv_escape(F.col("event_type")).alias("plain"))


@query("fn_dot_escape", r"""SELECT doc_id, replace(replace(replace('\' || text, '\', '\\'), '"', '\"'), chr(10), '\n') AS escaped FROM documents""")
def fn_dot_escape(spark, sf):
    return X.read(spark, sf, "documents").select("doc_id", S.dot_escape(F.concat(F.lit("\\"), F.col("text"))).alias("escaped"))


@query("fn_semver", "SELECT p_partkey, p_partkey % 3 <> 0 AS is_version, p_partkey % 4 NOT IN (0, 1) AS is_key FROM part")
def fn_semver(spark, sf):
    n = F.col("p_partkey")
    v = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(".1"))).otherwise(F.concat(F.lit("0."), n.cast("string"), F.lit(".1")))
    k = F.when(n % 4 == 0, F.lit(":name")).when(n % 4 == 1, F.lit("ns:")).otherwise(F.concat(F.lit("ns:"), "p_name"))
    return X.read(spark, sf, "part").select("p_partkey", S.is_semver(v).alias("is_version"), S.is_extension_key(k).alias("is_key"))


@query("fn_parse_file_id", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_partkey END AS file_id FROM part")
def fn_parse_file_id(spark, sf):
    n = F.col("p_partkey")
    t = F.when(n % 3 == 0, F.format_string("file-%06d", n)).when(n % 3 == 1, n.cast("string")).otherwise(F.concat(F.lit("file-x"), n.cast("string")))
    return X.read(spark, sf, "part").select("p_partkey", S.parse_file_id(t).alias("file_id"))


@query("fn_rfc3339", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS micros FROM events")
def fn_rfc3339(spark, sf):
    good = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    text = F.when(F.col("event_id") % 14 == 0, "").when(F.col("event_id") % 7 == 0, "not a time").otherwise(good)
    return X.read(spark, sf, "events").select("event_id", F.unix_micros(S.rfc3339(text)).alias("micros"))


@query("path_guard", "SELECT p_partkey, p_partkey % 4 = 0 AS path_ok, p_partkey % 3 = 0 AS job_ok FROM part")
def path_guard(spark, sf):
    n, name = F.col("p_partkey"), F.col("p_name")
    p = F.element_at(F.array(F.concat(F.lit("analysis/"), name, F.lit("..x")), F.concat(F.lit("a/../"), name), F.concat(F.lit("a\\..\\"), name), F.concat(F.lit("\\"), name)), (n % 4 + 1).cast("int"))
    j = F.element_at(F.array(F.concat(F.lit("job-"), n.cast("string")), F.concat(F.lit("job/"), n.cast("string")), F.concat(F.lit("job.."), n.cast("string"))), (n % 3 + 1).cast("int"))
    return X.read(spark, sf, "part").select("p_partkey", S.path_is_safe(p).alias("path_ok"), S.job_id_is_safe(j).alias("job_ok"))


@query("fn_hmac")
def fn_hmac(spark, sf):
    from ..functions.udfs import hmac_sha256_base64

    return X.read(spark, sf, "region").select("r_regionkey", hmac_sha256_base64(F.col("r_name"), F.lit("key")).alias("mac"))


@query("token_check")
def token_check(spark, sf):
    from ..functions.udfs import token_claims

    return X.read(spark, sf, "region").select("r_regionkey", token_claims(F.concat("r_name", F.lit(".x")), F.lit("key"), F.lit(0)).alias("reason"))
