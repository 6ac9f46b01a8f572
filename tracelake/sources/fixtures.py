"""Evidence tables as views over the driver's tables, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordered import running
from ..registry import RELATIONS


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def chunk_map(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk a document, in doc_id order."""
    size = F.octet_length("text").cast("long")
    docs = read(spark, sf, "documents").select("doc_id", size.alias("source_length"), F.sha2("text", 256).alias("h"))
    cum = running(docs, "doc_id", {"source_offset": F.col("source_length"), "sequence": F.lit(1)})
    return cum.select(
        "sequence", "source_offset", "source_length", S.tagged(F.col("h")).alias("chunk_id"), F.col("source_length").alias("stored_length"),
        F.lit("none").alias("compression"), F.col("h").alias("plaintext_sha256"), F.col("h").alias("stored_sha256"), "doc_id",
    )


RELATIONS["fx_chunk_map"] = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sequence,
       CAST(coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_offset,
       b AS source_length, 'sha256:' || h AS chunk_id, b AS stored_length, 'none' AS compression, h AS plaintext_sha256, h AS stored_sha256, doc_id
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS b, sha256(text) AS h FROM documents)"""


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_map(spark, sf).select("sequence", "chunk_id", "plaintext_sha256")


RELATIONS["fx_leaves"] = "SELECT sequence, chunk_id, plaintext_sha256 FROM fx_chunk_map"


def partitions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return read(spark, sf, "nation").select(_id("part-", "n_nationkey").alias("partition_id"), (k * 100000).alias("start_offset"), F.lit(100000).cast("long").alias("length"))


RELATIONS["fx_partitions"] = "SELECT 'part-' || n_nationkey AS partition_id, CAST(n_nationkey AS BIGINT) * 100000 AS start_offset, CAST(100000 AS BIGINT) AS length FROM nation"


def file_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang")
    d = docs.join(chunk_map(spark, sf).select("doc_id", "source_offset", "source_length"), "doc_id")
    i, file = F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    status = F.when(i % 41 == 0, "error").when(i % 13 == 0, "partial").otherwise("ok")
    return d.select(
        i.alias("file_id"), F.concat(F.lit("volume-"), (i % 4).cast("string")).alias("partition_id"), F.concat("source", F.lit("/"), file).alias("path"), file.alias("filename"),
        F.col("lang").alias("extension"), F.col("source_length").alias("size_bytes"), F.col("source_offset").alias("extent_offset"), (F.col("source_length") + 100).alias("extent_length"),
        (i % 29 == 0).alias("is_directory"), (i % 17 == 0).alias("is_deleted"), status.alias("parser_status"),
    )


RELATIONS["fx_file_index"] = """
SELECT d.doc_id AS file_id, 'volume-' || (d.doc_id % 4) AS partition_id, source || '/' || d.doc_id || '.' || lang AS path, d.doc_id || '.' || lang AS filename,
       lang AS extension, source_length AS size_bytes, source_offset AS extent_offset, source_length + 100 AS extent_length,
       d.doc_id % 29 = 0 AS is_directory, d.doc_id % 17 = 0 AS is_deleted,
       CASE WHEN d.doc_id % 41 = 0 THEN 'error' WHEN d.doc_id % 13 = 0 THEN 'partial' ELSE 'ok' END AS parser_status
FROM documents d JOIN fx_chunk_map c ON d.doc_id = c.doc_id"""


def doc_objects(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("evidence_file"), F.lit("file"), F.lit("email")), (i % 3 + 1).cast("int"))
    return read(spark, sf, "documents").select(
        F.concat(F.lit("obj-"), F.lpad(i.cast("string"), 6, "0")).alias("object_id"), kind.alias("object_type"),
        F.when(i % 11 != 0, F.concat(i.cast("string"), F.lit("."), F.upper("lang"))).alias("name"),
        F.concat("source", F.lit("/"), i.cast("string"), F.lit("."), F.col("lang")).alias("logical_path"),
        F.when(i % 5 != 0, F.concat(F.lit("text/"), F.col("lang"))).alias("media_type"), F.when(i % 19 != 0, F.col("n_chars")).alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"), F.when(i % 13 == 0, "partial").otherwise("ok").alias("parser_status"), "source", "doc_id",
    )


RELATIONS["fx_doc_objects"] = """
SELECT 'obj-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS object_id, CASE doc_id % 3 WHEN 0 THEN 'evidence_file' WHEN 1 THEN 'file' ELSE 'email' END AS object_type,
       CASE WHEN doc_id % 11 <> 0 THEN doc_id || '.' || upper(lang) END AS name, source || '/' || doc_id || '.' || lang AS logical_path,
       CASE WHEN doc_id % 5 <> 0 THEN 'text/' || lang END AS media_type, CASE WHEN doc_id % 19 <> 0 THEN n_chars END AS size_bytes,
       sha256(text) AS sha256, CASE WHEN doc_id % 13 = 0 THEN 'partial' ELSE 'ok' END AS parser_status, source, doc_id
FROM documents"""


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers, suppliers and orders as objects of five roots."""
    nation = read(spark, sf, "nation")
    root = _id("root-", "n_regionkey")
    none = F.lit(None).cast("long")
    rows = lambda df, prefix, key, kind, name, size, r: df.select(_id(prefix, key).alias("object_id"), F.lit(kind).alias("object_type"), name.alias("name"), size.alias("size_bytes"), r.alias("root_id"))
    keys = F.broadcast(nation.select("n_nationkey", "n_regionkey"))  # one row a nation
    customer = read(spark, sf, "customer").join(keys, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, sf, "supplier").join(keys, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customer.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        rows(read(spark, sf, "region"), "r", "r_regionkey", "filesystem", F.col("r_name"), none, _id("root-", "r_regionkey")),
        rows(nation, "n", "n_nationkey", "directory", F.col("n_name"), none, root),
        rows(customer, "c", "c_custkey", "container", F.col("c_name"), none, F.when(F.col("c_custkey") % 50 != 0, root)),
        rows(supplier, "s", "s_suppkey", "artifact", F.col("s_name"), none, root),
        rows(orders, "o", "o_orderkey", "file", F.lit(None).cast("string"), F.floor(F.col("o_totalprice") + 0.5).cast("long"), root),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("sha256", F.sha2("object_id", 256))


RELATIONS["fx_objects"] = """
SELECT *, sha256(object_id) AS sha256 FROM (
  SELECT 'r' || r_regionkey AS object_id, 'filesystem' AS object_type, r_name AS name, CAST(NULL AS BIGINT) AS size_bytes, 'root-' || r_regionkey AS root_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'directory', n_name, NULL, 'root-' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'container', c_name, NULL, CASE WHEN c_custkey % 50 <> 0 THEN 'root-' || n_regionkey END FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, 'artifact', s_name, NULL, 'root-' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'o' || o_orderkey, 'file', NULL, CAST(floor(o_totalprice + 0.5) AS BIGINT), 'root-' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def edge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda df, p, c, rel: df.select(p.alias("parent_object_id"), c.alias("child_object_id"), F.lit(rel).alias("relation_type"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    refs = orders.where("o_orderkey % 10 = 3").join(F.broadcast(read(spark, sf, "supplier").where("s_suppkey < 50").select("s_suppkey")), F.col("s_suppkey") == F.col("o_orderkey") % 50)
    out = pair(read(spark, sf, "nation"), _id("r", "n_regionkey"), _id("n", "n_nationkey"), "contains")
    out = out.union(pair(read(spark, sf, "customer"), _id("n", "c_nationkey"), _id("c", "c_custkey"), "contains"))
    out = out.union(pair(read(spark, sf, "supplier"), _id("n", "s_nationkey"), _id("s", "s_suppkey"), "contains"))
    out = out.union(pair(orders, _id("c", "o_custkey"), _id("o", "o_orderkey"), "contains"))
    return out.union(pair(refs, _id("o", "o_orderkey"), _id("s", "s_suppkey"), "references"))


RELATIONS["fx_edge_pairs"] = """
SELECT 'r' || n_regionkey AS parent_object_id, 'n' || n_nationkey AS child_object_id, 'contains' AS relation_type FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'contains' FROM orders
UNION ALL SELECT 'o' || o_orderkey, 's' || s_suppkey, 'references' FROM orders JOIN supplier ON s_suppkey = o_orderkey % 50 WHERE o_orderkey % 10 = 3"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    roots = objects(spark, sf).select("object_id", "root_id")
    e = edge_pairs(spark, sf)
    e = e.join(roots.withColumnsRenamed({"object_id": "parent_object_id", "root_id": "parent_root_id"}), "parent_object_id", "left")
    e = e.join(roots.withColumnsRenamed({"object_id": "child_object_id", "root_id": "child_root_id"}), "child_object_id", "left")
    eid = S.edge_id(F.col("parent_object_id"), F.col("child_object_id"), F.col("relation_type"))
    return e.select(eid.alias("edge_id"), "parent_object_id", "child_object_id", "parent_root_id", "child_root_id", "relation_type")


RELATIONS["fx_edges"] = """
SELECT 'edge-' || substr(sha256(parent_object_id || '|' || child_object_id || '|' || relation_type), 1, 24) AS edge_id, parent_object_id, child_object_id,
       p.root_id AS parent_root_id, c.root_id AS child_root_id, relation_type
FROM fx_edge_pairs e LEFT JOIN fx_objects p ON p.object_id = parent_object_id LEFT JOIN fx_objects c ON c.object_id = child_object_id"""


def derivations(spark: SparkSession, sf: str) -> DataFrame:
    p, c = F.col("parent_object_id"), F.col("child_object_id")
    given = F.when(F.length(p) == 3, F.lit(None)).when(F.substring(p, 2, 2) == "10", F.sha2(F.lit("bad"), 256)).otherwise(F.sha2(p, 256))
    e = edges(spark, sf).where("relation_type = 'references'")
    return e.select(
        S.derivation_id(p, c).alias("derivation_id"), p, c, "parent_root_id", "child_root_id", F.lit("content_extraction").alias("method"),
        given.alias("input_sha256"), F.sha2(c, 256).alias("output_sha256"),
    )


RELATIONS["fx_derivations"] = """
SELECT 'drv-' || substr(sha256(parent_object_id || '|' || child_object_id), 1, 24) AS derivation_id, parent_object_id, child_object_id, parent_root_id, child_root_id,
       'content_extraction' AS method,
       CASE WHEN length(parent_object_id) = 3 THEN NULL WHEN substr(parent_object_id, 2, 2) = '10' THEN sha256('bad') ELSE sha256(parent_object_id) END AS input_sha256,
       sha256(child_object_id) AS output_sha256
FROM fx_edges WHERE relation_type = 'references'"""


def object_events(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "signup", "discovered").when(t.isin("click", "purchase"), "updated").when(t == "error", "removed").otherwise("viewed")
    return read(spark, sf, "events").select(F.col("event_id").alias("seq"), _id("u", "user_id").alias("object_id"), kind.alias("event_type"), F.when(F.col("event_id") % 23 != 0, F.col("value")).alias("payload_value"))


RELATIONS["fx_object_events"] = """
SELECT event_id AS seq, 'u' || user_id AS object_id,
       CASE WHEN event_type = 'signup' THEN 'discovered' WHEN event_type IN ('click', 'purchase') THEN 'updated' WHEN event_type = 'error' THEN 'removed' ELSE 'viewed' END AS event_type,
       CASE WHEN event_id % 23 <> 0 THEN value END AS payload_value FROM events"""


def edge_events(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between users and the kinds of their events."""
    t = F.col("event_type")
    kind = F.when(t == "error", "removed").when(t == "view", "viewed").otherwise("discovered")
    u, k = _id("u", "user_id"), F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))
    return read(spark, sf, "events").select(F.col("event_id").alias("seq"), S.edge_id(u, k, F.lit("touches")).alias("edge_id"), u.alias("source_object_id"), k.alias("target_object_id"), kind.alias("event_type"), F.lit("touches").alias("relationship"))


RELATIONS["fx_edge_events"] = """
SELECT event_id AS seq, 'edge-' || substr(sha256('u' || user_id || '|k' || (event_id % 7) || '|touches'), 1, 24) AS edge_id, 'u' || user_id AS source_object_id, 'k' || (event_id % 7) AS target_object_id,
       CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'view' THEN 'viewed' ELSE 'discovered' END AS event_type, 'touches' AS relationship FROM events"""


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return read(spark, sf, "events").select(
        n.alias("line_no"), F.concat(F.lit("evt-"), F.lpad(n.cast("string"), 6, "0")).alias("event_id"), _id("user-", "user_id").alias("actor"), F.col("event_type").alias("action"),
        F.lit("collector").alias("tool_name"), F.lit("1.0.0").alias("tool_version"),
    )


RELATIONS["fx_provenance"] = """
SELECT event_id AS line_no, 'evt-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS event_id, 'user-' || user_id AS actor, event_type AS action, 'collector' AS tool_name, '1.0.0' AS tool_version FROM events"""


def roots(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey")
    return read(spark, sf, "region").select(_id("root-", "r_regionkey").alias("root_id"), F.when(k == 3, "detached").otherwise("active").alias("status"), F.when(k == 4, "offline").otherwise("online").alias("availability"), F.col("r_name").alias("name"), F.element_at(F.array(F.lit("embedded"), F.lit("relative"), F.lit("absolute"), F.lit("uri"), F.lit("uri")), (k + 1).cast("int")).alias("ref_type"))


RELATIONS["fx_roots"] = """
SELECT 'root-' || r_regionkey AS root_id, CASE WHEN r_regionkey = 3 THEN 'detached' ELSE 'active' END AS status, CASE WHEN r_regionkey = 4 THEN 'offline' ELSE 'online' END AS availability, r_name AS name,
       CASE r_regionkey WHEN 0 THEN 'embedded' WHEN 1 THEN 'relative' WHEN 2 THEN 'absolute' ELSE 'uri' END AS ref_type FROM region"""


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 1, "relevant").otherwise("low_quality")
    return read(spark, sf, "labels").select(F.concat(F.lit("lab-"), F.col("doc_id").cast("string")).alias("label_event_id"), F.concat(F.lit("obj-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("target_id"), label.alias("label"))


RELATIONS["fx_label_events"] = """
SELECT 'lab-' || doc_id AS label_event_id, 'obj-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS target_id, CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 1 THEN 'relevant' ELSE 'low_quality' END AS label FROM labels"""


def access_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return read(spark, sf, "conversations").select(F.concat(F.lit("acc-"), k).alias("access_event_id"), F.col("role").alias("actor"), F.when(F.col("turn") % 3 == 2, "denied").otherwise("allowed").alias("result"), (F.col("turn") % 3 == 2).alias("is_denied"))


RELATIONS["fx_access_events"] = """
SELECT 'acc-' || conv_id || '-' || turn AS access_event_id, role AS actor, CASE WHEN turn % 3 = 2 THEN 'denied' ELSE 'allowed' END AS result, turn % 3 = 2 AS is_denied FROM conversations"""
