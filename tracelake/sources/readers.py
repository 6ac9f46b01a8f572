"""Readers of tables, logs, documents and blobs below a root folder (any Hadoop URI)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.udfs import decompress
from . import packed, schemas
from .store import shared_dir, stored


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob, names anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """df in a schema: required columns must be there, optional ones become nulls (or a default), numbers are cast.

    A number beyond the target type is an error, not a wrapped value (ANSI casts).
    """
    have, cols = set(df.columns), []
    for f in schema.fields:
        if f.name in have:
            col = F.col(f.name).cast(f.dataType)
            cols.append((F.coalesce(col, F.lit(defaults[f.name])) if defaults and f.name in defaults else col).alias(f.name))
        elif f.nullable:
            cols.append(F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name} is missing")
    return df.select(*cols)


def table(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    return conform(spark.read.parquet(path), schema, defaults)


def chunk_map(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, f"{root}/indexes/physical_to_chunk.parquet", schemas.CHUNK_MAP).orderBy("sequence")


def leaves(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, f"{root}/integrity/leaves.parquet", schemas.LEAVES).orderBy("sequence")


_FLAGS = dict.fromkeys(("is_directory", "is_deleted", "is_sparse", "is_compressed", "is_encrypted"), False)


def file_index(spark: SparkSession, root: str, partition: str | None = None) -> DataFrame:
    """File rows of one or all partitions, with the folder's name as volume; absent flags are false."""
    df = spark.read.parquet(f"{root}/indexes/filesystems/{partition or '*'}/file_index.parquet")
    volume = F.regexp_extract(F.col("_metadata.file_path"), r"/filesystems/([^/]+)/", 1).alias("volume")
    names = [f.name for f in schemas.FILE_INDEX.fields]
    return conform(df.select("*", volume), T.StructType([*schemas.FILE_INDEX.fields, T.StructField("volume", T.StringType())]), _FLAGS).select(*names, "volume")


def objects(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, f"{root}/indexes/objects/object_index.parquet", schemas.OBJECT_INDEX)


def edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, f"{root}/indexes/objects/object_edges.parquet", schemas.OBJECT_EDGES)


def derivations(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, f"{root}/indexes/objects/derivations.parquet", schemas.DERIVATIONS)


def batches(df: DataFrame, rows: int):
    """Lists of rows, rows at a time (0: Spark's own batch size), fetched a partition at a time."""
    size = rows or int(df.sparkSession.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
    out = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of a JSON-lines log: blank lines are skipped, a missing file is empty, a bad line is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def batched(df: DataFrame, rows: int) -> DataFrame:
    """(batch, rows): df in lists of `rows` rows in its own order, the last one shorter; made by tasks, where batches() hands them to the driver."""
    base = shared_dir(df.sparkSession)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    kept = stored(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("_id")), f"{base}/rows")  # ids hold for one run
    parts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = stored(parts.select("_part", before.alias("_before")), f"{base}/parts")  # a row for each of df's partitions
    at = kept.withColumn("_part", part).join(F.broadcast(known), "_part").select((F.col("_before") + place).alias("at"), "row")
    lists = at.groupBy(F.floor(F.col("at") / rows).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows"))
    return lists.select("batch", F.col("rows.row").alias("rows"))


#: Pieces of log files whose places are broadcast at most; more are joined by sorting.
PIECES = 50_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, before, value) of non-blank lines; before: lines of the files that come first by name.

    A file is read in the pieces that Spark cuts it into, none of it as a whole. The lines are stored once with an id that follows their order
    in a piece; a piece's place in its file is what the pieces before it hold.
    """
    base = shared_dir(spark)
    raw = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id")]
    lines = stored(raw.select(*at, F.regexp_replace("value", "\r$", "").alias("value")), f"{base}/lines")
    full = F.trim("value") != ""
    pieces = stored(lines.groupBy("file", "piece").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.when(full, F.col("id"))).alias("last")), f"{base}/pieces")
    place = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1
    pieces = pieces.withColumn("place", place)
    files = pieces.groupBy("file").agg(F.coalesce(F.max(F.col("last") + F.col("place")), F.lit(0)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = stored(pieces.join(files.select("file", before.alias("before")), "file").select("file", "piece", "place", "before"), f"{base}/places")
    known = F.broadcast(known) if known.limit(PIECES + 1).count() <= PIECES else known.hint("merge")
    return lines.where(full).join(known, ["file", "piece"]).select("file", (F.col("id") + F.col("place")).alias("line_no"), "before", "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of non-blank lines; line_no counts from 1 in each file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line_no long, value string")
    return _lines(spark, path).drop("before")


def ordered_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records with seq, their place in the log: files by name, then lines. A bad line is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"seq long, {ddl}")
    rec = F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("r")
    return _lines(spark, path).select((F.col("line_no") + F.col("before")).alias("seq"), rec).select("seq", "r.*")


def extension_log(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Typed extension log; `sets` is all three set files."""
    if kind == "sets":
        out = None
        for part in ("working", "release", "exclusion"):
            df = jsonl(spark, f"{root}/{schemas.LOG_FILES[part]}", schemas.LOGS["sets"])
            out = df if out is None else out.unionByName(df)
        return out
    return jsonl(spark, f"{root}/{schemas.LOG_FILES[kind]}", schemas.LOGS[kind])


def sets_file(root: str, set_type: str) -> str:
    """File of a set type; an unknown type is a working set."""
    return f"{root}/{schemas.LOG_FILES[set_type if set_type in ('working', 'release', 'exclusion') else 'working']}"


def document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One-row frame of a JSON document."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def jobs(spark: SparkSession, root: str, ddl: str) -> DataFrame:
    """Job documents in the order of their file names; documents that do not parse are left out."""
    read = spark.read.schema(f"{ddl}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return read.json(f"{root}/jobs/*.json").select("*", name.alias("file")).where("_corrupt IS NULL").drop("_corrupt").orderBy("file")


def deltas(spark: SparkSession, root: str, name: str, ddl: str) -> DataFrame:
    """Rows of all jobs' delta logs with job_dir and line, in the order that merges take them."""
    lines = numbered_lines(spark, f"{root}/analysis/jobs/*/{name}_delta.jsonl*")
    job = F.regexp_extract("file", r"/analysis/jobs/([^/]+)/", 1).alias("job_dir")
    return lines.select(job, F.col("line_no").alias("line"), F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("r")).select("job_dir", "line", "r.*")


#: Bytes and rows of files that a task holds at once, but for one larger file.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1024


def files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, size, content) of the data files below a folder, empty ones too, which Spark's own reader of binary files leaves out.
    Tasks list and read the folders; the driver lists the first levels."""
    heads = packed.heads(path)
    names = ["path", "size", *(["content"] if content else [])]

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for head in b.column(0).to_pylist():
                for name, size in packed.files(head):
                    data = ()
                    if content:
                        with packed.opened(name) as f:
                            data = (f.read(),)
                        held += size
                    rows.append((name, size, *data))
                    if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                        yield _batch(rows, names)
                        rows, held = [], 0
        yield _batch(rows, names)

    frame = spark.createDataFrame([(h,) for h in heads], "path string").repartition(max(1, -(-len(heads) // 4)))
    return frame.mapInArrow(run, "path string, size bigint" + (", content binary" if content else ""))


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = {"path": pa.string(), "size": pa.int64(), "piece": pa.int64(), "start": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[n]) for k, n in enumerate(names)], names=names)


def pieces(spark: SparkSession, path: str, piece: int) -> DataFrame:
    """(path, piece, start, content) of fixed-size ranges of all files below a folder. Runs of ranges are dealt to tasks by hash, so that a large file
    is read by many and no file is held as a whole; tasks are as many as packed.RUN_BYTES fit the files, a file more counting a little."""
    per = max(1, packed.RUN_BYTES // piece)
    n = F.ceil(F.col("size") / piece)
    found = files(spark, path, content=False).where("size > 0")
    cost = found.agg(F.sum(F.col("size") + packed.FILE_COST)).first()[0] or 0
    runs = found.select("path", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(per).cast("long"))).alias("first"))
    runs = runs.select("path", "first", F.least("n", F.col("first") + per).alias("last")).repartition(max(1, -(-cost // packed.RUN_BYTES)), "path", "first")
    names = ["path", "piece", "start", "content"]

    def run(batches):
        rows = []
        for b in batches:
            for name, first, last in zip(*(b.column(k).to_pylist() for k in range(3))):
                with packed.opened(name) as f:
                    for k in range(first, last):
                        f.seek(k * piece)
                        rows.append((name, k, k * piece, f.read(piece)))
                        if len(rows) * piece >= BATCH_BYTES:
                            yield _batch(rows, names)
                            rows = []
        yield _batch(rows, names)

    return runs.mapInArrow(run, "path string, piece bigint, start bigint, content binary")


def digest_in(path: Column) -> Column:
    """The digest in a blob's name."""
    return F.regexp_extract(path, r"([0-9a-f]{64})\.[a-z]+$", 1)


def blobs(spark: SparkSession, root: str, store: str, content: bool = True) -> DataFrame:
    """(path, size, digest in the name, content) of a content-addressed store; without content only names are listed."""
    return files(spark, f"{root}/{store}", content).select("path", "size", digest_in(F.col("path")).alias("digest"), *(["content"] if content else []))


def verified_blobs(spark: SparkSession, root: str, store: str) -> DataFrame:
    """blobs() with ok: whether the content has the digest of the name."""
    return blobs(spark, root, store).withColumn("ok", F.sha2("content", 256) == F.col("digest"))


def read_chunks(spark: SparkSession, root: str, chunks: DataFrame) -> DataFrame:
    """chunks with plain bytes and an outcome: ok, missing, stored_hash, compression or plain_hash."""
    want = chunks.withColumn("rel", S.chunk_path(F.col("chunk_id")))
    files = blobs(spark, root, "chunks").select(F.concat(F.lit("chunks/"), F.regexp_extract("path", r"/chunks/(.*)$", 1)).alias("rel"), F.col("content").alias("stored"))
    j = want.join(files, "rel", "left").withColumn("plain", decompress(F.col("stored"), F.col("compression")))
    outcome = (
        F.when(F.col("stored").isNull(), "missing")
        .when(F.sha2("stored", 256) != F.col("stored_sha256"), "stored_hash")
        .when(F.col("plain").isNull(), "compression")
        .when(F.sha2("plain", 256) != F.col("plaintext_sha256"), "plain_hash")
        .otherwise("ok")
    )
    return j.withColumn("outcome", outcome).drop("rel", "stored")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(key, size) of everything below analysis/, in order of the key."""
    df = files(spark, f"{root}/analysis", content=False)
    return df.select(F.regexp_extract("path", r"/(analysis/.*)$", 1).alias("key"), "size").orderBy("key")


def resolve_uri(uri: str) -> str:
    """The path Spark reads: s3:// becomes s3a://, a local path stays."""
    if uri.startswith("s3://"):
        bucket, _, key = uri[5:].partition("/")
        if not bucket:
            raise ValueError("a bucket is missing")
        return f"s3a://{bucket}/{key}".rstrip("/")
    return uri.rstrip("/") if len(uri) > 1 else uri


def s3_options(endpoint: str | None) -> dict[str, str]:
    """Hadoop settings for an endpoint of one's own, with the bucket in the path."""
    return {"fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": "true"} if endpoint else {}
