"""Queries of the join semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lineage as L
from ..operators.ranges import overlap_join, point_join, slices
from ..registry import RELATIONS, query
from ..sources import fixtures as X

#: Bin of the chunk map's interval joins: several average chunks.
BIN = 65536

RELATIONS["fx_live_objects"] = "SELECT * FROM fx_objects WHERE CAST(substr(object_id, 2) AS BIGINT) % 97 <> 0"
RELATIONS["fx_live_edges"] = "SELECT * FROM fx_edges WHERE NOT (relation_type = 'references' AND CAST(substr(parent_object_id, 2) AS BIGINT) % 103 = 3)"


def live_objects(spark, sf):
    """Objects but for injected faults: every 97th key is missing."""
    return X.objects(spark, sf).where(F.substring("object_id", 2, 20).cast("long") % 97 != 0)


def live_edges(spark, sf):
    """Edges but for injected faults: some references are missing."""
    return X.edges(spark, sf).where(~((F.col("relation_type") == "references") & (F.substring("parent_object_id", 2, 20).cast("long") % 103 == 3)))


def _spans(spark, sf):
    c = X.chunk_map(spark, sf)
    return c.select("sequence", "chunk_id", F.col("source_offset").alias("cs"), (F.col("source_offset") + F.col("source_length")).alias("ce"))


@query("join_range_overlap", "SELECT partition_id, sequence, chunk_id FROM fx_partitions p JOIN fx_chunk_map c ON source_offset < start_offset + length AND source_offset + source_length > start_offset")
def join_range_overlap(spark, sf):
    p = X.partitions(spark, sf).select("partition_id", F.col("start_offset").alias("ps"), (F.col("start_offset") + F.col("length")).alias("pe"))
    return overlap_join(p, _spans(spark, sf), ("ps", "pe"), ("cs", "ce"), BIN).select("partition_id", "sequence", "chunk_id")


def file_chunks(spark, sf):
    f = X.file_index(spark, sf).select("file_id", F.col("extent_offset").alias("es"), (F.col("extent_offset") + F.col("extent_length")).alias("ee"))
    pairs = overlap_join(f, _spans(spark, sf), ("es", "ee"), ("cs", "ce"), BIN)
    return pairs.groupBy("file_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_refs"))


@query("join_file_chunks", "SELECT file_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_refs, count(*) AS n FROM (SELECT DISTINCT file_id, chunk_id FROM fx_file_index JOIN fx_chunk_map ON source_offset < extent_offset + extent_length AND source_offset + source_length > extent_offset) GROUP BY file_id")
def join_file_chunks(spark, sf):
    return file_chunks(spark, sf).select("file_id", F.array_join("chunk_refs", ",").alias("chunk_refs"), F.size("chunk_refs").cast("long").alias("n"))


@query("join_offset_point", "SELECT event_id, x, sequence, x - source_offset AS delta, CASE WHEN sequence IS NULL THEN 'miss' ELSE 'ok' END AS outcome FROM (SELECT event_id, event_id * 3001 AS x FROM events) LEFT JOIN fx_chunk_map ON source_offset <= x AND x < source_offset + source_length")
def join_offset_point(spark, sf):
    x = X.read(spark, sf, "events").select("event_id", (F.col("event_id") * 3001).alias("x"))
    j = point_join(x, _spans(spark, sf), "x", ("cs", "ce"), BIN)
    return j.select("event_id", "x", "sequence", (F.col("x") - F.col("cs")).alias("delta"), F.when(F.col("sequence").isNull(), "miss").otherwise("ok").alias("outcome"))


def byte_ranges(spark, sf, ranges):
    """(range_id, piece digest, filled, ok) of ranges (range_id, rs, re) over the documents' bytes."""
    text = X.read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    parts = X.chunk_map(spark, sf).select("doc_id", "source_offset", "source_length").withColumn("ce", F.col("source_offset") + F.col("source_length"))
    near = overlap_join(ranges, parts, ("rs", "re"), ("source_offset", "ce"), BIN).join(text, "doc_id")
    cut = slices(near, F.col("rs"), F.col("re"), "source_offset", "content")
    whole = cut.groupBy("range_id", "rs", "re").agg(F.sum(F.octet_length("piece")).alias("filled"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["piece"]))
    return whole.select("range_id", F.sha2(joined, 256).alias("digest"), F.col("filled").cast("long").alias("filled"), (F.col("filled") == F.col("re") - F.col("rs")).alias("complete"))


@query("join_byte_range")
def join_byte_range(spark, sf):
    r = X.partitions(spark, sf).select(F.col("partition_id").alias("range_id"), (F.col("start_offset") + 17).alias("rs"), (F.col("start_offset") + 5017).alias("re"))
    return byte_ranges(spark, sf, r)


@query("join_hit_to_file", "WITH refs AS (SELECT DISTINCT file_id, chunk_id FROM fx_file_index JOIN fx_chunk_map ON source_offset < extent_offset + extent_length AND source_offset + source_length > extent_offset WHERE NOT is_directory AND NOT is_deleted) SELECT c.sequence, c.chunk_id, coalesce(CAST(min(file_id) AS VARCHAR), '') AS file_id FROM fx_chunk_map c LEFT JOIN refs ON refs.chunk_id = c.chunk_id GROUP BY c.sequence, c.chunk_id")
def join_hit_to_file(spark, sf):
    f = X.file_index(spark, sf).where("NOT is_directory AND NOT is_deleted").select("file_id")
    refs = file_chunks(spark, sf).join(f, "file_id").select("file_id", F.explode("chunk_refs").alias("chunk_id"))
    first = refs.groupBy("chunk_id").agg(F.min("file_id").alias("file_id"))
    return X.chunk_map(spark, sf).select("sequence", "chunk_id").join(first, "chunk_id", "left").select("sequence", "chunk_id", F.coalesce(F.col("file_id").cast("string"), F.lit("")).alias("file_id"))


for _kind, _rel in (("edge", "fx_edges"), ("drv", "fx_derivations")):
    for _end in ("parent", "child"):
        _idc = "edge_id" if _kind == "edge" else "derivation_id"

        @query(f"anti_{_kind}_{_end}", f"SELECT {_idc} AS id, {_end}_object_id AS missing FROM {_rel} WHERE {_end}_object_id NOT IN (SELECT object_id FROM fx_live_objects)")
        def _anti(spark, sf, kind=_kind, end=_end, idc=_idc):
            links = X.edges(spark, sf) if kind == "edge" else X.derivations(spark, sf)
            return L.missing_endpoint(links, live_objects(spark, sf), f"{end}_object_id").select(F.col(idc).alias("id"), F.col(f"{end}_object_id").alias("missing"))


@query("anti_drv_edge", "SELECT derivation_id FROM fx_derivations d WHERE NOT EXISTS (SELECT 1 FROM fx_live_edges e WHERE e.parent_object_id = d.parent_object_id AND e.child_object_id = d.child_object_id)")
def anti_drv_edge(spark, sf):
    return L.derivations_without_edge(X.derivations(spark, sf), live_edges(spark, sf)).select("derivation_id")


@query("semi_drv_hash", "SELECT side, result, count(*) AS n FROM (SELECT 'input' AS side, CASE WHEN input_sha256 IS NULL OR o.sha256 IS NULL THEN 'warn' WHEN input_sha256 = o.sha256 THEN 'ok' ELSE 'fail' END AS result FROM fx_derivations d LEFT JOIN fx_live_objects o ON o.object_id = parent_object_id UNION ALL SELECT 'output', CASE WHEN output_sha256 IS NULL OR o.sha256 IS NULL THEN 'warn' WHEN output_sha256 = o.sha256 THEN 'ok' ELSE 'fail' END FROM fx_derivations d LEFT JOIN fx_live_objects o ON o.object_id = child_object_id) GROUP BY side, result")
def semi_drv_hash(spark, sf):
    return L.derivation_hashes(X.derivations(spark, sf), live_objects(spark, sf)).groupBy("side", "result").agg(F.count(F.lit(1)).alias("n"))


@query("missing_contains_parent", "SELECT object_id FROM fx_objects WHERE object_type = 'file' AND object_id NOT IN (SELECT child_object_id FROM fx_edges WHERE relation_type = 'contains' AND parent_root_id IS NOT NULL)")
def missing_contains_parent(spark, sf):
    return L.without_parent(X.objects(spark, sf), X.edges(spark, sf).where("parent_root_id IS NOT NULL"), "file", "contains").select("object_id")


@query("root_in_index", "SELECT root_id, EXISTS (SELECT 1 FROM fx_objects o WHERE o.object_id = replace(r.root_id, 'root-', CASE WHEN r.root_id = 'root-2' THEN 'x' ELSE 'r' END)) AS found FROM fx_roots r")
def root_in_index(spark, sf):
    r = X.roots(spark, sf).select("root_id", F.when(F.col("root_id") == "root-2", F.replace("root_id", F.lit("root-"), F.lit("x"))).otherwise(F.replace("root_id", F.lit("root-"), F.lit("r"))).alias("object_id"))
    hit = r.join(X.objects(spark, sf).select("object_id"), "object_id", "left_semi").select("root_id", F.lit(True).alias("found"))
    return r.select("root_id").join(hit, "root_id", "left").select("root_id", F.coalesce("found", F.lit(False)).alias("found"))


RELATIONS["fx_bad_leaves"] = "SELECT CASE WHEN sequence > 10 THEN sequence - 1 ELSE sequence END AS sequence, CASE sequence WHEN 20 THEN sha256('x') ELSE plaintext_sha256 END AS plaintext_sha256 FROM fx_chunk_map WHERE sequence <> 10"


def bad_leaves(spark, sf):
    s = F.col("sequence")
    return X.leaves(spark, sf).where("sequence <> 10").select(F.when(s > 10, s - 1).otherwise(s).alias("sequence"), F.when(s == 20, F.sha2(F.lit("x"), 256)).otherwise(F.col("plaintext_sha256")).alias("plaintext_sha256"))


def map_against_leaves(chunks, leaves):
    """One row: counts, whether they differ, and the first position whose hashes differ."""
    both = chunks.select("sequence", F.col("plaintext_sha256").alias("a")).join(leaves.select("sequence", F.col("plaintext_sha256").alias("b")), "sequence", "full_outer")
    return both.agg(F.count("a").alias("chunks"), F.count("b").alias("leaves"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("sequence"))).alias("first_mismatch")).withColumn("outcome", F.when(F.col("chunks") != F.col("leaves"), "count").when(F.col("first_mismatch").isNotNull(), "hash").otherwise("ok"))


@query("map_vs_leaves", "SELECT count(a) AS chunks, count(b) AS leaves, min(CASE WHEN a IS DISTINCT FROM b THEN sequence END) AS first_mismatch, CASE WHEN count(a) <> count(b) THEN 'count' ELSE 'hash' END AS outcome FROM (SELECT coalesce(c.sequence, l.sequence) AS sequence, c.plaintext_sha256 AS a, l.plaintext_sha256 AS b FROM fx_chunk_map c FULL JOIN fx_bad_leaves l ON c.sequence = l.sequence)")
def map_vs_leaves(spark, sf):
    return map_against_leaves(X.chunk_map(spark, sf), bad_leaves(spark, sf))


@query("children", "SELECT edge_id, child_object_id, relation_type FROM fx_edges WHERE parent_object_id = 'n1'")
def children(spark, sf):
    return X.edges(spark, sf).where("parent_object_id = 'n1'").select("edge_id", "child_object_id", "relation_type")


@query("parents", "SELECT edge_id, parent_object_id, relation_type FROM fx_edges WHERE child_object_id = 's3'")
def parents(spark, sf):
    return X.edges(spark, sf).where("child_object_id = 's3'").select("edge_id", "parent_object_id", "relation_type")


def pointers(spark, sf):
    """Parent pointers of suppliers and customers: the nation, and for every 7th customer a supplier."""
    c = X.read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("object_id"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("s"), (F.col("c_custkey") % 10 + 1).cast("string"))).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("parent_id"))
    n = X.read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    s = X.read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return c.union(n).union(s)


RELATIONS["fx_pointers"] = "SELECT 'c' || c_custkey AS object_id, CASE WHEN c_custkey % 7 = 0 THEN 's' || (c_custkey % 10 + 1) ELSE 'n' || c_nationkey END AS parent_id FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


def _page(df, offset, limit):
    return df.orderBy("via", "object_id").offset(offset).limit(limit).select("object_id", "object_type", F.col("via").cast("long").alias("via"))


def _page_sql(here, there, p_here, p_there, node, offset, limit):
    return f"SELECT object_id, object_type, CAST(min(via) AS BIGINT) AS via FROM (SELECT {there} AS object_id, 0 AS via FROM fx_edges WHERE {here} = '{node}' UNION ALL SELECT {p_there}, 1 FROM fx_pointers WHERE {p_here} = '{node}') JOIN fx_objects USING (object_id) GROUP BY object_id, object_type ORDER BY via, object_id LIMIT {limit} OFFSET {offset}"


@query("children_objects", _page_sql("parent_object_id", "child_object_id", "parent_id", "object_id", "s3", 2, 40))
def children_objects(spark, sf):
    return _page(L.neighbours(X.objects(spark, sf), X.edges(spark, sf), pointers(spark, sf), "s3", up=False), 2, 40)


@query("parents_objects", _page_sql("child_object_id", "parent_object_id", "object_id", "parent_id", "c7", 0, 40))
def parents_objects(spark, sf):
    return _page(L.neighbours(X.objects(spark, sf), X.edges(spark, sf), pointers(spark, sf), "c7", up=True), 0, 40)


@query("object_root_lookup", "SELECT w.object_id, s.root_id, CASE WHEN s.n IS NULL THEN 'not_found' WHEN s.n > 1 THEN 'ambiguous' WHEN s.root_id IS NULL THEN 'no_root' WHEN r.status IS NULL THEN 'missing_root' WHEN r.status <> 'active' THEN 'inactive_root' ELSE 'ok' END AS outcome FROM (SELECT 'c' || (c_custkey + 10) AS object_id FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation) w LEFT JOIN (SELECT object_id, count(*) AS n, min(root_id) AS root_id FROM (SELECT object_id, root_id FROM fx_objects UNION ALL SELECT object_id, root_id FROM fx_objects WHERE object_id IN ('n1', 'n2')) GROUP BY object_id) s ON s.object_id = w.object_id LEFT JOIN (SELECT * FROM fx_roots WHERE root_id <> 'root-1') r ON r.root_id = s.root_id")
def object_root_lookup(spark, sf):
    o = X.objects(spark, sf).select("object_id", "root_id")
    o = o.union(o.where(F.col("object_id").isin("n1", "n2")))
    w = X.read(spark, sf, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") + 10).cast("string")).alias("object_id")).union(X.read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    return L.root_lookup(w, o, X.roots(spark, sf).where("root_id <> 'root-1'"))


@query("object_content_resolve", "SELECT object_id, CASE doc_id % 5 WHEN 0 THEN 'chunk' WHEN 1 THEN 'evidence' WHEN 2 THEN 'derived' WHEN 3 THEN 'evidence' ELSE 'none' END AS store, CASE doc_id % 5 WHEN 0 THEN 'chunks/' || p || '.chunk' WHEN 1 THEN 'evidence/objects/' || p || '.bin' WHEN 2 THEN 'derived/objects/' || p || '.bin' WHEN 3 THEN 'evidence/objects/' || p || '.bin' END AS path FROM (SELECT object_id, doc_id, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 AS p FROM fx_doc_objects)")
def object_content_resolve(spark, sf):
    k = F.col("doc_id") % 5
    o = X.doc_objects(spark, sf).withColumns({"ref_type": F.when(k == 0, "chunk").when(k == 1, "evidence_object_store").when(k == 2, "derived_object_store"), "storage_ref": F.when(k == 3, S.tagged(F.col("sha256")))})
    return content_location(o)


def content_location(objects):
    """(object_id, store, path): where an object's bytes are, by its content reference, else its storage reference."""
    t = F.col("ref_type")
    store = F.when(t == "chunk", "chunk").when(t == "evidence_object_store", "evidence").when(t == "derived_object_store", "derived").when(t.isNull() & F.col("storage_ref").isNotNull(), "evidence").otherwise("none")
    h = F.col("sha256")
    path = F.when(store == "chunk", S.chunk_path(h)).when(store == "evidence", S.evidence_path(F.coalesce("storage_ref", h))).when(store == "derived", S.derived_path(h))
    return objects.select("object_id", store.alias("store"), path.alias("path"))
