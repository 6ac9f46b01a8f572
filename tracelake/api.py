"""Container: one object for reading, walking, checking and adding to an evidence container; every method gives a DataFrame
unless it says otherwise."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import graph, lineage, merkle, replay, scope, shards
from .operators.ranges import overlap_join, slices
from .plans import checks
from .sources import packed, readers, schemas, sinks

VERSIONS = ("0.1.0", "0.2.0")
_MANIFEST = "case_id string, version string, acquisition_mode string, source struct<sha256:string,size:bigint>, merkle_root string"


class Container:
    """A container below a root folder (any URI that Spark reads). profile: strict refuses unknown versions, permissive
    takes any, auto takes a missing one as the oldest."""

    def __init__(self, spark: SparkSession, root: str, profile: str = "auto"):
        if profile not in ("auto", "strict", "permissive"):
            raise ValueError(profile)
        self.spark, self.root = spark, readers.resolve_uri(root)
        version = self.manifest().select("version").first()[0]
        if profile == "auto":
            version = version or VERSIONS[0]
        if profile != "permissive" and version not in VERSIONS:
            raise ValueError(f"version {version} is unknown")
        self.version = version

    # Documents, tables, logs

    def manifest(self) -> DataFrame:
        d = readers.document(self.spark, f"{self.root}/manifest.json", _MANIFEST)
        return d.withColumn("acquisition_mode", F.coalesce("acquisition_mode", F.lit("block_image")))

    def chunk_map(self) -> DataFrame:
        return readers.chunk_map(self.spark, self.root)

    def leaves(self) -> DataFrame:
        return readers.leaves(self.spark, self.root)

    def files(self, partition: str | None = None) -> DataFrame:
        return readers.file_index(self.spark, self.root, partition)

    def objects(self) -> DataFrame:
        return readers.objects(self.spark, self.root)

    def edges(self) -> DataFrame:
        return readers.edges(self.spark, self.root)

    def derivations(self) -> DataFrame:
        return readers.derivations(self.spark, self.root)

    def extension(self, kind: str) -> DataFrame:
        return readers.extension_log(self.spark, self.root, kind)

    def custody(self) -> DataFrame:
        return readers.ordered_log(self.spark, f"{self.root}/provenance/chain_of_custody.jsonl", schemas.LOGS["custody"])

    def batches(self, table: DataFrame, rows: int = 0) -> Iterator[list]:
        return readers.batches(table, rows)

    # Bytes

    def chunks(self, refs: list[str] | None = None) -> DataFrame:
        """Plain bytes of all or of named chunks (numbers or ids), with an outcome each."""
        c = readers.table(self.spark, f"{self.root}/indexes/physical_to_chunk.parquet", schemas.CHUNK_MAP)
        if refs is not None:
            c = c.where(F.col("chunk_id").isin(*refs) | F.col("sequence").isin(*[int(r) for r in refs if r.isdigit()]))
        return readers.read_chunks(self.spark, self.root, c)

    def read_bytes(self, offset: int, length: int) -> bytes:
        """Bytes of a range of the source; ValueError where a chunk is missing or damaged."""
        if length == 0:
            return b""
        want = self.spark.createDataFrame([(offset, offset + length)], "rs long, re long")
        c = readers.table(self.spark, f"{self.root}/indexes/physical_to_chunk.parquet", schemas.CHUNK_MAP).withColumn("ce", F.col("source_offset") + F.col("source_length"))
        near = overlap_join(want, c, ("rs", "re"), ("source_offset", "ce"), 64 << 20)
        parts = slices(readers.read_chunks(self.spark, self.root, near).where("outcome = 'ok'"), F.col("rs"), F.col("re"), "source_offset", "plain")
        out = b"".join(bytes(r.piece) for r in parts.orderBy("at").select("piece").toLocalIterator())
        if len(out) != length:
            raise ValueError("the range is not covered")
        return out

    def at(self, offset: int) -> DataFrame:
        """The chunk that holds an offset, and the place within it."""
        c = self.chunk_map().where((F.col("source_offset") <= offset) & (F.col("source_offset") + F.col("source_length") > offset))
        return c.select("sequence", "chunk_id", (F.lit(offset) - F.col("source_offset")).alias("delta"))

    def export(self, path: str) -> str:
        """The raw source as a local file; its digest, checked against the manifest's."""
        want = self.manifest().select("source.sha256").first()[0]
        return sinks.raw_export(self.chunks().where("outcome = 'ok'"), "sequence", "plain", path, want)

    # Graph

    def list_objects(self, object_type: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        o = self.objects() if object_type is None else self.objects().where(F.col("object_type") == object_type)
        return o.orderBy("object_id").offset(offset).limit(limit)

    def children(self, object_id: str) -> DataFrame:
        return self.edges().where(F.col("parent_object_id") == object_id)

    def parents(self, object_id: str) -> DataFrame:
        return self.edges().where(F.col("child_object_id") == object_id)

    def ancestors(self, object_id: str, shortcuts: bool = True) -> DataFrame:
        return graph.ancestor_edges(self.edges(), object_id, shortcuts)

    def roots(self) -> DataFrame:
        return lineage.roots(self.objects(), self.edges())

    def tree(self) -> DataFrame:
        return graph.tree(self.edges(), self.roots().select(F.col("object_id").alias("node")))

    # Jobs

    def scope(self, selectors: scope.Selectors) -> DataFrame:
        return scope.resolve(self.objects(), selectors)

    def shard(self, selectors: scope.Selectors, job: str, strategy: str, n: int) -> DataFrame:
        return shards.manifests(self.scope(selectors), job, strategy, n)

    def write_rows(self, df: DataFrame, job: str, name: str) -> str:
        return sinks.write_once(df, self.root, job, name)

    def append(self, kind: str, df: DataFrame) -> None:
        """Records for an extension log; sets go to the file of their set_type, which must be one."""
        if kind == "sets":
            for r in df.select("set_type").distinct().collect():  # three types
                sinks.append_log(df.where(F.col("set_type") == r[0]), readers.sets_file(self.root, r[0]))
        else:
            sinks.append_log(df, f"{self.root}/{schemas.LOG_FILES[kind]}")

    def merge_deltas(self) -> DataFrame:
        """The object index with all jobs' deltas, first writers first."""
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.OBJECT_INDEX.fields)
        return replay.merge_indexes(readers.deltas(self.spark, self.root, "objects", ddl), self.objects(), "object_id")

    # Checks

    def merkle_root(self) -> str:
        return merkle.root(self.leaves()).first().root

    def verify(self, profile: str = "core") -> DataFrame:
        """Checks (id, name, status, severity, n, example) of a profile: core, blobs, objects or lineage."""
        if profile == "core":
            want = self.manifest().select(F.lit("root").alias("id"), F.col("merkle_root"))
            wrong = want.where(F.col("merkle_root").isNotNull() & (F.col("merkle_root") != F.lit(self.merkle_root())))
            rules = [*checks.core(self.chunk_map(), self.leaves()), checks.rule("merkle root", wrong, "id")]
        elif profile == "blobs":
            rules = [checks.rule("chunks read back", self.chunks().where("outcome <> 'ok'"), "sequence")]
        elif profile in ("objects", "lineage"):
            rules = getattr(checks, profile)(self.objects(), self.edges(), self.derivations())
        else:
            raise ValueError(profile)
        return checks.report(rules)


def create(spark: SparkSession, root: str, parts: DataFrame, case_id: str, compressed: bool = True) -> Container:
    """A new container of parts (sequence, content): chunk store, map, leaves and, last, the manifest. Refuses to touch one that is there."""
    if readers.exists(spark, f"{root}/manifest.json"):
        raise FileExistsError(root)

    from .functions.udfs import compress
    from .operators.ordered import running
    from .sources.store import shared_dir, stored

    plain = F.col("content")
    rows = parts.select("sequence", "content", F.octet_length("content").cast("long").alias("source_length"), F.sha2(plain, 256).alias("plaintext_sha256"))
    rows = rows.withColumn("data", compress(plain) if compressed else plain).drop("content")
    rows = rows.withColumns({"stored_sha256": F.sha2("data", 256), "stored_length": F.octet_length("data").cast("long"), "compression": F.lit("zstd" if compressed else "none"), "chunk_id": S.tagged(F.col("plaintext_sha256"))})
    rows = stored(rows, shared_dir(spark))
    sinks.store_blobs(rows.select(S.chunk_path(F.col("chunk_id")).alias("path"), "data"), root, "path", "data").count()
    table = running(rows.drop("data"), "sequence", {"source_offset": F.col("source_length")})
    sinks.table(table, f"{root}/indexes/physical_to_chunk.parquet", schemas.CHUNK_MAP, sort="sequence")
    sinks.table(table, f"{root}/integrity/leaves.parquet", schemas.LEAVES, sort="sequence")
    size = rows.agg(F.sum("source_length")).first()[0] or 0
    top = merkle.root(readers.leaves(spark, root)).first()
    digest = sinks.stream_digest(parts, "sequence", "content")
    sinks.text_file(spark, f"{root}/manifest.json", json.dumps({"case_id": case_id, "version": VERSIONS[-1], "source": {"sha256": digest, "size": size}, "merkle_root": top.root if top else None}), overwrite=False)
    return Container(spark, root)


pack, unpack, read_packed = packed.write, packed.unpack, packed.read_index
