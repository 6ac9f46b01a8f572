"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint is cut into SEGMENTS ring segments. If two fingerprints differ in at most TAU bits, some
chain of consecutive segments (around the ring) has, for each of its prefixes of l segments, at most
l * TAU / SEGMENTS differing bits. With 5 segments and TAU 4 the budgets are 0, 1, 2, 3, 4: the first
segment of the chain is equal and the second differs in one bit at most. Those two segments are the
join key: the indexed side has one key a start, the probing side the 1 + width variants of the second
segment. Longer prefixes prune inside a bucket before the full Hamming check.

Cases: null, empty or blank texts have fingerprint zero and link like any other; fewer than four words make one
shingle of the whole sequence; repeated doc_ids give one row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, merged, shared_dir, shuffle_width, small_batches, stored, table

SHINGLE, SEED, TAU = 4, 42, 4
#: Bits of each ring segment, from the low end.
WIDTHS = (13, 13, 13, 13, 12)
#: Members of a bucket that one task compares at once; larger buckets are cut into blocks, block against block.
BLOCK = 2048

_SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each UTF-8 text (uint64)."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
        if not words:
            continue
        if len(words) <= SHINGLE:
            out[k] = h64(b" ".join(words), SEED)
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -SHINGLE] + 1))
        hashes = np.array([h64(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())], dtype=np.uint64)
        out[k] = majority(hashes)
    return out


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    raw = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every row; fp holds the 64 bits."""
    small_batches(docs.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(texts).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(_SHIFTS, WIDTHS)]


def _key(start: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((np.uint64(start) << np.uint64(32)) | (first << np.uint64(13)) | second).view(np.int64)


def ring_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint its indexed keys and its probing keys: (row, key, probe)."""
    parts, m = _parts(fp), len(WIDTHS)
    rows, keys, probes = [], [], []
    idx = np.arange(len(fp), dtype=np.int32)
    for s in range(m):
        a, b = parts[s], parts[(s + 1) % m]
        rows.append(idx), keys.append(_key(s, a, b)), probes.append(np.zeros(len(fp), dtype=bool))
        for bit in range(WIDTHS[(s + 1) % m]):
            rows.append(idx), keys.append(_key(s, a, b ^ np.uint64(1 << bit))), probes.append(np.ones(len(fp), dtype=bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(probes)


def _chain_masks() -> np.ndarray:
    """Row s: for l = 1.. segments, the bits of the chain of l segments that starts at s."""
    m = len(WIDTHS)
    one = [((1 << w) - 1) << k for w, k in zip(WIDTHS, _SHIFTS)]
    return np.array([[sum(one[(s + i) % m] for i in range(n)) for n in range(1, m + 1)] for s in range(m)], dtype=np.uint64)


_MASKS = _chain_masks()


def block_links(left: np.ndarray, right: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs between two blocks of fingerprints that share the bucket of a chain start.

    The longer prefixes of the chain are tested first; the last of them, the whole ring, is the Hamming check.
    """
    out_a, out_b, m = [], [], len(WIDTHS)
    for i in range(0, len(left), 256):
        x = left[i : i + 256, None].view(np.uint64) ^ right[None, :].view(np.uint64)
        a, b = np.nonzero((x != 0) & (np.bitwise_count(x & _MASKS[start, 2]) * m <= 3 * TAU))
        d = x[a, b]
        for step in range(3, m):
            keep = np.bitwise_count(d & _MASKS[start, step]) * m <= (step + 1) * TAU
            a, b, d = a[keep], b[keep], d[keep]
        if len(a):
            out_a.append(a + i), out_b.append(b)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) that span the groups of the edges a-b."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low), np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp bigint. Edges (a, b) that span the classes linked within each bucket; all links lie inside them."""
    spark = fps.sparkSession
    small_batches(spark, 4096)
    width = shuffle_width(spark)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(fp):
                rows, keys, probes = ring_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows]), pa.array(probes)], names=["key", "fp", "probe"])

    keyed = fps.mapInArrow(explode, "key bigint, fp bigint, probe boolean")
    # Most keys have one member: two aggregates without the members find the buckets that hold a pair.
    size = keyed.groupBy("key").agg(F.count_if(~F.col("probe")).alias("n"), F.count_if("probe").alias("p")).where("n >= 1 and n + p >= 2")
    live = merged(keyed, size, "key").withColumn("blocks", F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("p")) / BLOCK)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Indexed rows stay in their own block; every row probes all blocks of its bucket, block by block.
    index = live.where("not probe").select("key", own.alias("block"), "fp", F.lit(False).alias("probe"), F.lit(0).alias("slice"))
    probe = live.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", "fp", F.lit(True).alias("probe"), own.alias("slice"))
    # A block meets its probers BLOCK at a time, so a task holds about 2 * BLOCK fingerprints of a bucket.
    cells = index.union(probe)
    cells = cells.repartition(width, "key", "block").sortWithinPartitions("key", "block", "probe", "slice")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: list[tuple[np.ndarray, np.ndarray]] = []
        here, index_rows, waiting, n_wait = None, [], [], 0

        def flush() -> None:
            nonlocal waiting, n_wait
            if index_rows and waiting:
                right = np.concatenate(waiting)
                left = index_rows[0] if len(index_rows) == 1 else np.concatenate(index_rows)
                i, j = block_links(left, right, int(here[0]) >> 32)
                if len(i):
                    spent.append((left[i], right[j]))
            waiting, n_wait = [], 0

        for b in batches:
            key, block, fp, probe = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(key):
                continue
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(probe.astype(np.int8)) != 0)) + 1
            for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))):
                at = (key[lo], block[lo])
                if at != here:
                    flush()
                    here, index_rows = at, []
                if probe[lo]:
                    waiting.append(fp[lo:hi].astype(np.int64)), (n_wait := n_wait + hi - lo)
                    if n_wait >= BLOCK:
                        flush()
                else:
                    index_rows.append(fp[lo:hi].astype(np.int64))
            if sum(len(x) for x, _ in spent) >= 200_000:
                yield _edges(spent)
                spent = []
        flush()
        if spent:
            yield _edges(spent)

    return cells.select("key", "block", "fp", "probe").mapInArrow(pairs, "a bigint, b bigint").distinct()


def _edges(spent: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = forest(np.concatenate([x for x, _ in spent]), np.concatenate([y for _, y in spent]))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id whose fingerprint is reachable by links."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    fps = stored(with_fingerprints(docs, id_col, text_col), f"{base}/fp")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), f"{base}/classes")
    edges = links(classes.select("fp")).select(F.col("a"), F.col("b"))
    roots = components(edges).withColumnsRenamed({"node": "fp", "root": "root_fp"})
    named = merged(classes, roots, "fp", "left").withColumn("root_fp", F.coalesce("root_fp", "fp"))
    lows = named.groupBy("root_fp").agg(F.min("low").alias("component"))
    of_class = merged(named, lows, "root_fp").select("fp", "component")
    return merged(fps, of_class, "fp").select("id", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
