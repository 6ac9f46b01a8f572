"""SimHash near-duplicates of five-word shingles with an exact check: links are pairs of Jaccard similarity NUM / DEN at least.

simhash.links() proposes pairs: fingerprints of the distinct shingles, pigeonring filtering, at most simhash.TAU bits. Two texts of similarity
0.8 differ in about 10 of 64 bits, up to 17; a budget so wide would need thousands of keys a fingerprint. So a prefix filter
proposes the pairs that fingerprints cannot. In any one order of all shingles take the first p = n - ceil(n * NUM / DEN) + 1 of a set, and
n // EXTRA more. Of the two prefixes' ends one comes first in the order: what both sets hold up to there is in both prefixes, what they hold behind
it is behind that prefix. So c shingles in both prefixes and max(n - p, n' - p') bound what the sets share; pairs whose bound is below the
similarity are dropped, after narrow rows of names have been counted. Before that, and inside the join, parity maps drop pairs: each shingle
flips one of BITS bits of its set's map, so two maps differ in at most as many bits as the sets have shingles that only one of them holds,
and similar sets have (DEN - NUM) / (DEN + NUM) of their sizes' sum of those at most. The others are verified on the whole sets. The order is by
hash, shingles that many prefixes would hold last: which ones those are changes the number of candidates, never the result.

Links are wanted for components only. Fingerprints' pairs and each shingle's members against the smallest of them are verified first; then
pairs of members that are still in different components and whose parity maps allow a link. So a large group of near copies does not leave the
join pair by pair; inside a shingle's bucket, members of different components are compared by their maps.

Cases: words and shingles as in simhash.py; null, empty and blank texts have no shingles and link to each other only; texts
of fewer than SHINGLE words are one shingle; repeated doc_ids give one row each; an empty table gives no rows; other columns are
ignored. Sets are named by 64-bit hashes of their shingles' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, drop_path, merged, release, shared_dir, shuffle_width, small_batches, stored

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Prefixes are longer by this part of a set: more rows, fewer pairs to verify.
EXTRA = 20
#: Bits of a set's parity map, in columns of 64.
BITS = 512
MAP = [f"m{k}" for k in range(BITS // 64)]
#: Shingles that are in over COMMON rows' prefixes come last in the order, the COMMON_MOST commonest of them.
COMMON, COMMON_MOST = 50, 1_000_000
#: So many counted set names at most are broadcast, so that only the sets they name are shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles of pairs that a round of the check moves for each shuffle partition.
ROUND = 1 << 20


def shingles_of(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes (int64), sorted."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    grams = {h64(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.sort(np.fromiter(grams, dtype=np.uint64, count=len(grams)).view(np.int64))


def name_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """BITS bits (int64 each 64): whether an odd number of shingles falls on each."""
    odd = np.bincount(shingles.view(np.uint64) & np.uint64(BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate((shingles[~last], shingles[last]))
    return shingles[: n + (-n * NUM) // DEN + 1 + n // EXTRA]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def signatures(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray, whole: bool = False) -> DataFrame:
    """(id, name, n, shingles) of every row: its set's name and size and the whole set; or the prefix, with (fp, *MAP): fingerprint and parity map."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    held = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(x or b"") for x in b.column(1).to_pylist()]
            names, sizes = pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            head = [b.column(0), names, sizes]
            if whole:
                yield pa.RecordBatch.from_arrays([*head, _lists(sets)], names=["id", "name", "n", "shingles"])
                continue
            fps = pa.array([int(simhash.majority(s).view(np.int64)) if len(s) else 0 for s in sets], pa.int64())
            maps = np.array([parity_map(s) for s in sets], dtype=np.int64).reshape(-1, len(MAP))
            columns = [*head, _lists([prefix_of(s, held.value) for s in sets]), fps, *[pa.array(m) for m in maps.T.copy()]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "name", "n", "shingles", "fp", *MAP])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "" if whole else ", ".join(["", "fp bigint", *[f"{m} bigint" for m in MAP]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, name bigint, n bigint, shingles array<bigint>{more}")


def common_shingles(docs: DataFrame, id_col: str, text_col: str, base: str) -> np.ndarray:
    """The shingles in over COMMON prefixes, the commonest first, about COMMON_MOST at most; where a count's shingles do not all fit, a part of them
    by their hash. The driver gets no others, as it would from a limit that it collects, to which every partition sends its own."""
    each = signatures(docs, id_col, text_col, np.zeros(0, dtype=np.int64)).select(F.explode("shingles").alias("s"))
    counts = stored(each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON), f"{base}/common")
    least, part = 0, 1.0
    room = COMMON_MOST
    for c, n in sorted(map(tuple, counts.groupBy("c").agg(F.count(F.lit(1))).collect()), reverse=True):  # a row for each number of prefixes
        least, part = c, min(1.0, room / n)
        room -= n
        if room <= 0:
            break
    kept = counts.where((F.col("c") > least) | (F.col("c") == least) & (F.pmod(F.xxhash64("s"), F.lit(1 << 20)) < int(part * (1 << 20))))
    return np.sort(kept.select("s").toArrow()["s"].to_numpy().astype(np.int64))


def _similar(same, a, b):
    """same / (a + b - same) >= NUM / DEN, in integers."""
    return same * (NUM + DEN) >= NUM * (a + b)


def _maps_near(left, right, a, b):
    """Whether two parity maps (columns in the order of MAP) leave sets of sizes a and b similar."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right)), F.lit(0))
    return apart * (NUM + DEN) <= (DEN - NUM) * (a + b)


def _bound(n):
    """Shingles of a set behind its prefix."""
    return F.ceil(n * NUM / DEN) - 1 - F.floor(n / EXTRA)


def strong(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, n, b, m), a row for each shingle that both prefixes hold: those that can be similar."""
    fit = pairs.where(_similar(F.least("n", "m"), F.col("n"), F.col("m")))
    c = fit.groupBy("a", "n", "b", "m").agg(F.count(F.lit(1)).alias("c"))
    return c.where(_similar(F.col("c") + F.greatest(_bound(F.col("n")), _bound(F.col("m"))), F.col("n"), F.col("m"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, base: str) -> DataFrame:
    """The pairs (a, b) of set names whose whole sets are similar; stored."""
    pairs = stored(pairs, f"{base}-pairs")
    release(docs.sparkSession)
    needed = stored(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct(), f"{base}-names")
    few = needed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    whole = signatures(docs, id_col, text_col, np.zeros(0, dtype=np.int64), whole=True).select("name", "shingles")
    named = whole.join(F.broadcast(needed), "name", "left_semi") if few else merged(whole, needed, "name", "left_semi")
    sets = stored(named.dropDuplicates(["name"]), f"{base}-sets")
    # A round moves about ROUND shingles a shuffle partition, so that what it leaves on disk is bounded.
    moved = merged(pairs, sets.select(F.col("name").alias("a"), F.size("shingles").alias("n")), "a").agg(F.sum("n")).first()[0] or 0
    rounds = max(1, -(-moved // (ROUND * shuffle_width(docs.sparkSession))))
    for k in range(rounds):
        part = pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k)
        both = merged(merged(part, sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a"), sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
        both.where(_similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b").write.mode("append").parquet(base)
        release(docs.sparkSession)
    drop_path(docs.sparkSession, f"{base}-sets"), drop_path(docs.sparkSession, f"{base}-pairs"), release(docs.sparkSession)
    return docs.sparkSession.read.schema(pairs.schema).parquet(base)


def fingerprint_pairs(classes: DataFrame, base: str) -> DataFrame:
    """(a, b): names whose fingerprints are linked, as a spanning forest; stored. classes: distinct (name, fp)."""
    first = stored(classes.groupBy("fp").agg(F.min("name").alias("rep")), f"{base}-reps")
    same = merged(classes, first, "fp").where("name <> rep").select(F.col("rep").alias("a"), F.col("name").alias("b"))
    found = stored(simhash.links(first.select("fp")).toDF("x", "y"), f"{base}-links")
    far = merged(merged(found, first.toDF("x", "a"), "x"), first.toDF("y", "b"), "y").select("a", "b")
    out = stored(same.union(far), base)
    release(classes.sparkSession)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, component): component is the smallest id whose set is reachable by links."""
    base = shared_dir(docs.sparkSession)
    common = common_shingles(docs, id_col, text_col, base)
    release(docs.sparkSession)
    found = stored(signatures(docs, id_col, text_col, common), f"{base}/prefixes")
    classes = stored(found.groupBy("name").agg(F.min("id").alias("low"), F.min("fp").alias("fp"), *[F.min(m).alias(m) for m in MAP]), f"{base}/classes")
    close = fingerprint_pairs(classes.select("name", "fp"), f"{base}/close")
    each = found.select("name", "n", F.explode("shingles").alias("s"))
    # Most shingles have one set: one aggregate without the members leaves the others.
    buckets = each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
    live = stored(merged(merged(each, buckets, "s", "left_semi").distinct(), classes.select("name", *MAP), "name"), f"{base}/live")
    release(docs.sparkSession)
    lows = live.groupBy("s").agg(F.min(F.struct("name", "n", *MAP)).alias("low"))
    met = (F.col("name") != F.col("low.name")) & _maps_near([F.col(m) for m in MAP], [F.col(f"low.{m}") for m in MAP], F.col("n"), F.col("low.n"))
    star = strong(merged(live, lows, "s").where(met).select(F.col("low.name").alias("a"), F.col("low.n").alias("n"), F.col("name").alias("b"), F.col("n").alias("m")))
    pairs = star.union(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    near = verified(pairs, docs, id_col, text_col, f"{base}/near")
    group = stored(components(near), f"{base}/groups")
    placed = stored(merged(live, group.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")), f"{base}/placed")
    left = placed.select("s", F.col("name").alias("a"), "n", "root", *MAP)
    right = placed.select("s", F.col("name").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), *[F.col(m).alias(f"r{m}") for m in MAP])
    met = F.expr("a < b AND root <> other") & _maps_near([F.col(m) for m in MAP], [F.col(f"r{m}") for m in MAP], F.col("n"), F.col("m"))
    apart = strong(merged(left, right, "s").where(met).select("a", "n", "b", "m"))
    rest = verified(apart, docs, id_col, text_col, f"{base}/rest")
    roots = components(near.union(rest)).withColumnsRenamed({"node": "name", "root": "root_name"})
    named = merged(classes, roots, "name", "left").withColumn("root_name", F.coalesce("root_name", "name"))
    lows = named.groupBy("root_name").agg(F.min("low").alias("component"))
    return merged(found.select("id", "name"), merged(named, lows, "root_name").select("name", "component"), "name").select("id", "name", "component")
