"""Queries of the disk parsers, over structures made from the fixture tables, and of the sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..registry import query
from ..sources import disk, images, packed, readers, schemas, sinks
from ..sources import fixtures as X
from ..sources.store import shared_dir
from .q_aggregates import report_counts
from .q_graph import entries
from .q_io import entries_of, write_graph


def _nations(spark, sf, n):
    return [(r.n_nationkey, r.n_name) for r in X.read(spark, sf, "nation").orderBy("n_nationkey").limit(n).collect()]


def _frame(spark, rows):
    cols = ["partition_id", "name", "partition_type", "start_offset", "length", "first_lba", "last_lba", "bootable"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], "partition_id string, name string, partition_type string, start_offset long, length long, first_lba long, last_lba long, bootable boolean")


_MBR = """SELECT p.partition_id, CAST(NULL AS VARCHAR) AS name, p.partition_type, CAST(n_nationkey * 1000 + p.rel AS BIGINT) * 512 AS start_offset, CAST(p.n * 512 AS BIGINT) AS length,
    CAST(n_nationkey * 1000 + p.rel AS BIGINT) AS first_lba, CAST(n_nationkey * 1000 + p.rel + p.n - 1 AS BIGINT) AS last_lba, p.bootable
FROM nation JOIN (VALUES (0, 'mbr-1', 'NTFS / exFAT (0x07)', 100, 500, true), (2, 'mbr-2', 'Linux Filesystem (0x83)', 100, 500, false),
    (3, 'ebr-1', 'Linux Filesystem (0x83)', 110, 100, NULL), (3, 'ebr-2', 'Linux Swap (0x82)', 155, 20, NULL)) p(k, partition_id, partition_type, rel, n, bootable) ON n_nationkey = p.k"""


@query("parse_mbr", _MBR)
def parse_mbr(spark, sf):
    """A record with an empty slot and a container, whose chain has two links; starts come from the first nations' keys."""
    at = [k * 1000 + 100 for k, _ in _nations(spark, sf, 4)]
    image = bytearray((at[3] + 60) * disk.SECTOR)
    records = {0: [(0x80, 7, at[0], 500), (0, 0, at[1], 0), (0, 0x83, at[2], 500), (0, 5, at[3], 500)], at[3]: [(0, 0x83, 10, 100), (0, 5, 50, 60)], at[3] + 50: [(0, 0x82, 5, 20)]}
    for lba, slots in records.items():
        image[lba * disk.SECTOR : (lba + 1) * disk.SECTOR] = images.boot_record(slots)
    return _frame(spark, disk.parse_mbr(disk.reader_of(bytes(image))))


_GPT = "SELECT 'gpt-' || (n_nationkey + 1) AS partition_id, n_name AS name, CASE n_nationkey % 2 WHEN 0 THEN 'EFI System Partition' ELSE 'Linux Swap' END AS partition_type, CAST(n_nationkey * 10 + 100 AS BIGINT) * 512 AS start_offset, CAST(10 * 512 AS BIGINT) AS length, CAST(n_nationkey * 10 + 100 AS BIGINT) AS first_lba, CAST(n_nationkey * 10 + 109 AS BIGINT) AS last_lba, CAST(NULL AS BOOLEAN) AS bootable FROM nation"


def _gpt(spark, sf, damaged=False):
    guids = {v: k for k, v in S.TYPE_GUIDS.items()}
    image = bytearray(images.gpt_image([(guids["EFI System Partition" if k % 2 == 0 else "Linux Swap"], k * 10 + 100, k * 10 + 109, name) for k, name in _nations(spark, sf, 25)]))
    if damaged:
        image[512 + 60] ^= 1
    return bytes(image)


@query("parse_gpt", _GPT)
def parse_gpt(spark, sf):
    image = _gpt(spark, sf)
    return _frame(spark, disk.parse_gpt(disk.reader_of(image), len(image)))


@query("parse_gpt_backup", _GPT)
def parse_gpt_backup(spark, sf):
    image = _gpt(spark, sf, damaged=True)
    return _frame(spark, disk.parse_gpt(disk.reader_of(image), len(image)))


_KINDS = ("NTFS", "exFAT", "FAT32", "FAT16", "FAT12", "FAT")


@query("parse_volume", "SELECT n_nationkey, ['NTFS', 'exFAT', 'FAT32', 'FAT16', 'FAT12', 'FAT', NULL][n_nationkey % 7 + 1] AS kind FROM nation")
def parse_volume(spark, sf):
    rows = [(k, disk.volume_type(images.boot_sector(_KINDS[k % 7]) if k % 7 < 6 else bytes(512))) for k, _ in _nations(spark, sf, 25)]
    return spark.createDataFrame(rows, "n_nationkey int, kind string")


@query("parse_dispatch", "SELECT * FROM (VALUES ('volume', CAST(1 AS BIGINT)), ('gpt', 25), ('mbr', 1), ('unknown', 0)) t(scheme, partitions)")
def parse_dispatch(spark, sf):
    inputs = [images.boot_sector("NTFS") + bytes(1024), _gpt(spark, sf), images.boot_record([(0, 0x83, 1, 2)]) + bytes(2048), bytes(4096)]
    found = [disk.parse_image(disk.reader_of(i), len(i)) for i in inputs]
    return spark.createDataFrame([(s, len(p)) for s, p in found], "scheme string, partitions long")


@query("parse_ntfs_vbr", "SELECT CAST(512 AS BIGINT) AS bytes_per_sector, CAST(4096 AS BIGINT) AS cluster, CAST(16384 AS BIGINT) AS mft_offset, CAST(1024 AS BIGINT) AS record")
def parse_ntfs_vbr(spark, sf):
    v = disk.parse_vbr(images.boot_sector("NTFS"))
    return spark.createDataFrame([(v["bytes_per_sector"], v["cluster"], v["mft_offset"], v["record"])], "bytes_per_sector long, cluster long, mft_offset long, record long")


@query("parse_ntfs_runs", "SELECT p_partkey, CAST(p_partkey * 3 AS BIGINT) AS lcn, CAST(p_size AS BIGINT) AS clusters FROM part UNION ALL SELECT p_partkey, p_partkey + 7, 1 FROM part")
def parse_ntfs_runs(spark, sf):
    def run(batches):
        for pdf in batches:
            rows = [(k, lcn, n) for k, size in zip(pdf["p_partkey"], pdf["p_size"]) for lcn, n in disk.parse_runs(images.run_bytes([(int(k) * 3, int(size)), (int(k) + 7, 1)]))]
            yield pd.DataFrame(rows, columns=["p_partkey", "lcn", "clusters"])

    return X.read(spark, sf, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, lcn long, clusters long")


#: Extension records have numbers from here on, behind those of all parts; record numbers have 48 bits.
EXTENSIONS = 1 << 40
#: Records that a task makes and parses, up to as many tasks as a shuffle has partitions.
RECORDS = 4096


def mft(spark, sf):
    """Records of a folder hierarchy of parts: two names each, runs, flags; every 40th has its name in an extension record."""

    def make(batches):
        for pdf in batches:
            rows = []
            for i, parent, name in zip(pdf["id"], pdf["parent"], pdf["name"]):
                i, parent = int(i), int(parent)
                names = [images.name_attribute(parent, f"{name[:6].upper()}~1", 2), images.name_attribute(parent, name, 1)]
                body = [images.times_attribute(134116992000000000, 0x200 if i % 10 == 0 else 0)]
                if i % 40 == 0:
                    rows.append((i, images.file_record([*body, images.list_attribute([EXTENSIONS + i]), images.data_attribute([(i, 2)], i * 10)])))
                    rows.append((EXTENSIONS + i, images.file_record(names, base=i)))
                else:
                    rows.append((i, images.file_record([*body, *names, images.data_attribute([(i, 2)], i * 10)], flags=0 if i % 17 == 0 else 1)))
            yield pd.DataFrame(rows, columns=["record", "content"])

    # The rows are few bytes and much work: a small file, or what AQE makes of a small shuffle, would leave them to a few tasks.
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), X.read(spark, sf, "part").count() // RECORDS + 1)
    rows = entries(spark, sf).where("id NOT IN (0, 5)").select("id", "parent", "name").repartition(tasks, "id")
    return rows.mapInPandas(make, "record long, content binary")


@query("parse_ntfs_record", "SELECT id AS record, CASE WHEN id % 40 = 0 THEN 'partial' ELSE 'ok' END AS status, CAST(CASE WHEN id % 40 = 0 THEN 0 ELSE 2 END AS BIGINT) AS names, id * 10 AS size FROM fx_entries WHERE id NOT IN (0, 5)")
def parse_ntfs_record(spark, sf):
    return disk.file_records(mft(spark, sf)).where("base = 0").select("record", "status", F.size("names").cast("long").alias("names"), "size")


@query("parse_ntfs_fixup", "SELECT id AS record, id % 3 <> 0 AS ok FROM fx_entries WHERE id NOT IN (0, 5) AND id % 40 <> 0")
def parse_ntfs_fixup(spark, sf):
    """Records whose second sector lost its update number are errors."""
    hurt = F.when(F.col("record") % 3 == 0, F.concat(F.substring("content", 1, 1022), F.lit(b"xx").cast("binary"))).otherwise(F.col("content"))
    raw = mft(spark, sf).where(f"record % 40 <> 0 AND record < {EXTENSIONS}").withColumn("content", hurt)
    return disk.file_records(raw).select("record", (F.col("status") != "error").alias("ok"))


@query("ntfs_best_name", "SELECT id AS record, name FROM fx_entries WHERE id NOT IN (0, 5) AND id % 40 <> 0")
def ntfs_best_name(spark, sf):
    r = disk.file_records(mft(spark, sf)).where("base = 0 AND record % 40 <> 0")
    return r.select("record", disk.preferred(F.col("names"))["name"].alias("name"))


@query("ntfs_attrlist_merge", "SELECT id AS record, 'ok' AS status, CAST(2 AS BIGINT) AS names FROM fx_entries WHERE id NOT IN (0, 5) AND id % 40 = 0")
def ntfs_attrlist_merge(spark, sf):
    m = disk.merge_lists(disk.file_records(mft(spark, sf))).where("record % 40 = 0")
    return m.select("record", "status", F.size("names").cast("long").alias("names"))


@query("ntfs_rows", r"""WITH RECURSIVE w(id, path) AS (SELECT id, '\' || name AS path FROM fx_entries WHERE parent = 5 AND id NOT IN (0, 5) UNION ALL SELECT e.id, w.path || '\' || e.name FROM w JOIN fx_entries e ON e.parent = w.id WHERE e.id NOT IN (0, 5)) SELECT e.id AS file_id, coalesce(w.path, '[orphan]\' || e.name) AS path, e.name AS filename, e.id * 10 AS size_bytes, '[{"offset":' || (e.id * 4096) || ',"length":8192}]' AS physical_extents, e.id % 10 = 0 AS is_sparse, e.id % 17 = 0 AND e.id % 40 <> 0 AS is_deleted, 'ok' AS parser_status, CAST(1767225600000000 AS BIGINT) AS created FROM fx_entries e LEFT JOIN w ON w.id = e.id WHERE e.id NOT IN (0, 5)""")
def ntfs_rows(spark, sf):
    rows = disk.file_rows(disk.file_records(mft(spark, sf)), 4096, 0)
    return rows.select("file_id", "path", "filename", "size_bytes", "physical_extents", "is_sparse", "is_deleted", "parser_status", "created")


# Sinks ----------------------------------------------------------------------------------------------------------


@query("sink_chunk_map", "SELECT count(*) AS rows, CAST(sum(source_length) AS BIGINT) AS bytes, max(chunk_id) AS last FROM fx_chunk_map")
def sink_chunk_map(spark, sf):
    path = f"{shared_dir(spark)}/physical_to_chunk.parquet"
    sinks.table(X.chunk_map(spark, sf), path, schemas.CHUNK_MAP, 400, "sequence")
    return readers.table(spark, path, schemas.CHUNK_MAP).agg(F.count(F.lit(1)).alias("rows"), F.sum("source_length").alias("bytes"), F.max("chunk_id").alias("last"))


@query("sink_leaves", "SELECT count(*) AS rows, min(plaintext_sha256) AS first FROM fx_leaves")
def sink_leaves(spark, sf):
    path = f"{shared_dir(spark)}/leaves.parquet"
    sinks.table(X.leaves(spark, sf), path, schemas.LEAVES)
    return readers.table(spark, path, schemas.LEAVES).agg(F.count(F.lit(1)).alias("rows"), F.min("plaintext_sha256").alias("first"))


@query("sink_file_index", "SELECT file_id, path, '' AS created_at, parser_status FROM fx_file_index")
def sink_file_index(spark, sf):
    """Timestamps that are unknown are empty texts in the table."""
    from .q_io import file_rows

    path = f"{shared_dir(spark)}/file_index.parquet"
    sinks.table(file_rows(spark, sf).drop("extent_offset", "extent_length").withColumn("created_at", F.lit("")), path, schemas.FILE_INDEX)
    return readers.table(spark, path, schemas.FILE_INDEX).select("file_id", "path", "created_at", "parser_status")


@query("sink_graph", "SELECT (SELECT count(*) FROM fx_objects) AS objects, (SELECT count(*) FROM fx_edges) AS edges, (SELECT count(*) FROM fx_derivations) AS derivations")
def sink_graph(spark, sf):
    root = shared_dir(spark)
    write_graph(spark, sf, root, 1000)
    n = [r(spark, root).count() for r in (readers.objects, readers.edges, readers.derivations)]
    return spark.createDataFrame([tuple(n)], "objects long, edges long, derivations long")


@query("sink_jsonl_append", "SELECT label, 2 * count(*) AS n FROM fx_label_events GROUP BY label")
def sink_jsonl_append(spark, sf):
    path = f"{shared_dir(spark)}/labels"
    for _ in range(2):
        sinks.append_log(X.label_events(spark, sf).select("label_event_id", "label"), path)
    return readers.jsonl(spark, path, "label_event_id string, label string").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def next_event(spark, path, prefix, rows):
    """Appends rows (struct columns) whose ids go on from the log's count; the log has one writer."""
    n = readers.numbered_lines(spark, path).count()
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy(*rows.columns)) + n  # a handful of events at a time
    sinks.append_log(rows.select(F.format_string(f"{prefix}-%06d", number).alias("event_id"), *rows.columns).coalesce(1), path)


@query("sink_provenance", "SELECT 'evt-' || lpad(CAST(r_regionkey + 1 AS VARCHAR), 6, '0') AS event_id, CASE WHEN r_regionkey < 3 THEN 'created' ELSE 'verified' END AS action FROM region")
def sink_provenance(spark, sf):
    path = f"{shared_dir(spark)}/custody"
    r = X.read(spark, sf, "region")
    next_event(spark, path, "evt", r.where("r_regionkey < 3").select(F.lit("created").alias("action"), "r_name"))
    next_event(spark, path, "evt", r.where("r_regionkey >= 3").select(F.lit("verified").alias("action"), "r_name"))
    return readers.jsonl(spark, path, "event_id string, action string")


@query("sink_correction_event", "SELECT 'analysis-correction-' || lpad(CAST(r_regionkey + 1 AS VARCHAR), 6, '0') AS event_id, r_name AS reason FROM region")
def sink_correction_event(spark, sf):
    path = f"{shared_dir(spark)}/corrections"
    next_event(spark, path, "analysis-correction", X.read(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("reason")))
    return readers.jsonl(spark, path, "event_id string, reason string")


@query("sink_delta", "SELECT object_id, object_type FROM fx_deltas")
def sink_delta(spark, sf):
    """Each job's delta is written once, below the job's own folder."""
    from .q_aggregates import deltas

    root, rows = shared_dir(spark), deltas(spark, sf)
    for job in [r.job_dir for r in rows.select("job_dir").distinct().collect()]:  # as many as there are jobs
        sinks.write_once(rows.where(F.col("job_dir") == job).select("object_id", "object_type"), root, job, "objects_delta.jsonl")
    return readers.jsonl(spark, f"{root}/analysis/jobs/*/objects_delta.jsonl", "object_id string, object_type string")


@query("sink_blob_dedup", "SELECT 'written' AS outcome, count(DISTINCT text) AS n FROM documents UNION ALL SELECT 'present', count(DISTINCT text) FROM documents")
def sink_blob_dedup(spark, sf):
    root = shared_dir(spark)
    d = X.read(spark, sf, "documents").select(S.evidence_path(F.sha2("text", 256)).alias("path"), F.col("text").cast("binary").alias("content"))
    counts = []
    for _ in range(2):
        counts += [(r.outcome, r["count"]) for r in sinks.store_blobs(d, root, "path", "content").groupBy("outcome").count().collect()]
    return spark.createDataFrame(counts, "outcome string, n long")


@query("sink_raw_export", "SELECT sha256(string_agg(n_name, '' ORDER BY n_nationkey)) AS digest FROM nation")
def sink_raw_export(spark, sf):
    parts = X.read(spark, sf, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("c"))
    path = shared_dir(spark) + "/export.raw"
    return spark.createDataFrame([(sinks.raw_export(parts, "n_nationkey", "c", path),)], "digest string")


@query("pack", "SELECT 'docs/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS path, 8 + CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM documents")
def pack(spark, sf):
    path = shared_dir(spark) + "/a.pk"
    sinks.archive(entries_of(spark, sf), path)
    spark.dataSource.register(packed.PackedSource)
    return spark.read.format("packed_archive").load(path).select("path", "offset")


@query("sink_json_atomic", "SELECT 'b' AS v")
def sink_json_atomic(spark, sf):
    path = f"{shared_dir(spark)}/doc.json"
    for v in "ab":
        sinks.text_file(spark, path, '{"v":"%s"}' % v)
    return readers.document(spark, path, "v string")


@query("worker_commit", "SELECT role AS outcome, count(*) AS n FROM conversations GROUP BY role")
def worker_commit(spark, sf):
    """A worker's rows are staged by Spark's commit protocol and sealed once; the sealed paths are the final ones."""
    root = shared_dir(spark)
    path = sinks.write_once(X.read(spark, sf, "conversations").select(F.col("role").alias("outcome")), root, "shard-1", "results.jsonl")
    return readers.jsonl(spark, path, "outcome string").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("overall_status", "SELECT CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'fail' ELSE 'pass' END AS overall FROM orders")
def overall_status(spark, sf):
    c = X.read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "fail").otherwise("ok").alias("status"))
    return report_counts(c, []).select("overall")
