"""Writers. Tables and logs go through Spark's commit protocol; logs are folders to which batches are appended."""

from __future__ import annotations

import hashlib

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import csv_escape, dot_escape
from . import packed
from .readers import conform, exists
from .store import shared_dir, stored


def table(df: DataFrame, path: str, schema: T.StructType, rows_per_file: int = 0, sort: str | None = None) -> None:
    """Rows in the schema; sorted by a key, so that row groups can be skipped by it."""
    out = conform(df, schema)
    if sort:
        out = out.repartitionByRange(F.col(sort)).sortWithinPartitions(sort)
    w = out.write.mode("overwrite")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Records as JSON lines in new files of the log's folder; nothing that is there is rewritten."""
    df.write.mode("append").option("ignoreNullFields", True).json(path)


def append_ordered(df: DataFrame, path: str, order: str) -> None:
    """append_log() of records in an order: each file holds a range of it, and the files' names follow it. The column is not written."""
    append_log(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).drop(order), path)


def write_once(df: DataFrame, root: str, job: str, name: str) -> str:
    """Analysis rows below a job's folder; refuses to overwrite and names that leave it."""
    if ".." in job or "/" in job or ".." in name or name.startswith("/") or "\\" in name:
        raise ValueError("a path leaves the job's folder")
    path = f"{root}/analysis/jobs/{job}/{name}"
    if exists(df.sparkSession, path):
        raise FileExistsError(path)
    df.write.mode("errorifexists").json(path)
    return path


def text_file(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """One small text file, written beside its place and moved there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(tmp, target)


def store_blobs(df: DataFrame, root: str, path_col: str, content_col: str) -> DataFrame:
    """Writes each distinct blob that is not there yet, from the executors; (path, outcome): written, present or conflict.

    A blob's path follows from its digest, so writing it twice (a task tried again) leaves the same file.
    """
    def run(batches):
        import uuid

        import pandas as pd

        store, base = packed.storage(root)
        for pdf in batches:
            out = []
            for rel, data in zip(pdf[path_col], pdf[content_col]):
                full = f"{base}/{rel}"
                if store.get_file_info(full).type == pafs.FileType.File:
                    with store.open_input_stream(full) as f:
                        same = hashlib.sha256(f.read()).digest() == hashlib.sha256(data).digest()
                    out.append("present" if same else "conflict")
                    continue
                tmp = f"{full}.{uuid.uuid4().hex}.tmp"
                with packed.create(f"{root}/{rel}" + tmp[len(full) :]) as f:
                    f.write(data)
                store.move(tmp, full)
                out.append("written")
            yield pd.DataFrame({"path": pdf[path_col], "outcome": out})

    return df.dropDuplicates([path_col]).select(path_col, content_col).mapInPandas(run, "path string, outcome string")


def spooled(parts: DataFrame, order: str, content: str, base: str) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Writes the rows' bytes in an order to files below base, a range of it each, by tasks. An index (part, at, length, sha256, order) of what is in
    which file where, stored, and the files (part, path, bytes) in order, one a task."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        path = f"{base}/{part:06d}-{uuid.uuid4().hex}"  # a task that is tried again has a file of its own
        with packed.create(path) as f:
            for b in batches:
                rows = [(x or b"") for x in b.column(1).to_pylist()]
                places = []
                for x in rows:
                    f.write(x)
                    places.append(at)
                    at += len(x)
                n = len(rows)
                columns = [pa.array([part] * n, pa.int32()), pa.array([path] * n, pa.string()), pa.array(places, pa.int64()), pa.array([len(x) for x in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()), b.column(0)], names=["part", "file", "at", "length", "sha256", order])

    kind = parts.schema[order].dataType.simpleString()
    ranged = parts.select(F.col(order), F.col(content).cast("binary")).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    index = stored(ranged.mapInArrow(run, f"part int, file string, at bigint, length bigint, sha256 string, {order} {kind}"), f"{base}-index")
    files = index.groupBy("part", "file").agg(F.sum("length").alias("n")).orderBy("part").collect()
    return index.drop("file"), [(r.part, r.file, r.n) for r in files]


def in_task(spark: SparkSession, work) -> str:
    """work() in a task on an executor, a text."""

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([work()])], names=["value"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "value string").collect()[0][0]


def _dropped(base: str) -> None:
    store, p = packed.storage(base)
    if store.get_file_info(p).type == pafs.FileType.Directory:
        store.delete_dir(p)


def stream_digest(parts: DataFrame, order: str, content: str) -> str:
    """SHA-256 of the parts' bytes in order: written to files by many tasks, read by one, for it is sequential; none pass through the driver."""
    base = f"{shared_dir(parts.sparkSession)}/spool"
    files = [f for _, f, _ in spooled(parts, order, content, base)[1]]

    def work():
        h = hashlib.sha256()
        packed.copy(files, None, h)
        return h.hexdigest()

    found = in_task(parts.sparkSession, work)
    _dropped(base)
    return found


def raw_export(parts: DataFrame, order: str, content: str, path: str, expected: str | None = None, shared: bool = False) -> str:
    """Concatenates parts in order to a file; its digest; removes it if the digest is not as expected. The parts are written to the shared folder by
    many tasks, then copied in blocks: by the driver, whose disk the path may name, or by a task where the path is shared."""
    base = f"{shared_dir(parts.sparkSession)}/spool"
    files = [f for _, f, _ in spooled(parts, order, content, base)[1]]

    def work():
        h = hashlib.sha256()
        with packed.create(path) as f:
            packed.copy(files, f, h)
        return h.hexdigest()

    found = in_task(parts.sparkSession, work) if shared else work()
    _dropped(base)
    if expected and found != expected:
        store, p = packed.storage(path)
        store.delete_file(p)
        raise ValueError("the export does not have the source's hash")
    return found


def archive(files: DataFrame, path: str) -> None:
    """A packed archive of files (path, content) at a shared path: contents and index entries are written by many tasks, one joins them."""
    spark = files.sparkSession
    base = f"{shared_dir(spark)}/spool"
    index, parts = spooled(files, "path", "content", f"{base}/content")
    starts, at = [], packed.HEADER_BYTES
    for part, _, n in parts:
        starts.append((part, at))
        at += n
    first = spark.createDataFrame(starts, "part int, first long")  # one row a task
    entry = F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), (F.col("first") + F.col("at")).alias("offset"), "length", "sha256")
    lines = index.join(F.broadcast(first), "part").select("path", F.concat(F.lit(","), F.to_json(entry)).alias("line"))
    entries = spooled(lines, "path", "line", f"{base}/entries")[1]
    contents, texts = [f for _, f, _ in parts], [f for _, f, _ in entries]
    in_task(spark, lambda: packed.join_archive(path, contents, texts) or path)
    _dropped(base)


def lineage_csv(edges: DataFrame) -> DataFrame:
    """(child, parents) lines of the lineage export, quoted where needed."""
    from ..operators.lineage import parents_csv

    p = parents_csv(edges)
    return p.select(F.concat_ws(",", csv_escape(F.col("child_object_id")), csv_escape(F.col("parents"))).alias("line"))


def lineage_dot(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and arc lines of a DOT graph, in order of `part`."""
    q = lambda c: F.concat(F.lit('"'), dot_escape(F.coalesce(c, F.lit(""))), F.lit('"'))
    label = F.concat(F.lit('"'), F.concat_ws("\\n", *[dot_escape(F.coalesce(F.col(c), F.lit(""))) for c in ("object_id", "name", "object_type")]), F.lit('"'))
    nodes = objects.select(F.lit(0).alias("part"), F.concat(F.lit("    "), q(F.col("object_id")), F.lit(" [label="), label, F.lit("];")).alias("line"))
    arcs = edges.select(F.lit(1).alias("part"), F.concat(F.lit("    "), q(F.col("parent_object_id")), F.lit(" -> "), q(F.col("child_object_id")), F.lit(" [label="), q(F.col("relation_type")), F.lit("];")).alias("line"))
    return nodes.union(arcs)


def lineage_json(objects: DataFrame, edges: DataFrame, derivations: DataFrame) -> DataFrame:
    """(part, line): one JSON object a row of the three tables."""
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(df.columns))).alias("line"))
    return part(objects, "objects").union(part(edges, "edges")).union(part(derivations, "derivations"))


def report_markdown(checks: DataFrame) -> str:
    """A report of checks (id, name, status, severity, message); a few dozen rows by nature."""
    rows = checks.orderBy("id").collect()
    lines = ["| id | name | status | severity | message |", "|---|---|---|---|---|"]
    return "\n".join([*lines, *[f"| {r.id} | {r.name} | {r.status} | {r.severity} | {r.message} |" for r in rows]]) + "\n"


def report_json(checks: DataFrame) -> DataFrame:
    """One JSON document with the checks and their counts."""
    body = F.array_sort(F.collect_list(F.struct("id", "name", "status", "severity", "message")))
    n = {s: F.count_if(F.col("status") == t).alias(s) for s, t in (("ok", "pass"), ("warn", "warning"), ("fail", "fail"))}
    one = checks.agg(body.alias("checks"), F.struct(*n.values()).alias("summary"))
    overall = F.when(F.col("summary.fail") > 0, "fail").when(F.col("summary.warn") > 0, "warning").otherwise("pass")
    return one.select(F.to_json(F.struct(overall.alias("overall_status"), "checks", "summary")).alias("document"))
