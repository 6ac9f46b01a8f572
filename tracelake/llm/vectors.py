"""Near-duplicate vectors: an exact metric range join by pivots.

Vectors are scaled to length 1, where cosine >= LEAST is a chord of at most sqrt(2 - 2 LEAST). Pivots (a bounded number of
vectors, lowest hash of the id) partition the vectors by the nearest pivot. A vector y of cell j can have a
partner in cell i only if its distance to the plane between the two pivots, (d(y, p_i)^2 - d(y, p_j)^2) / (2 d(p_i, p_j)), is
at most that chord: the triangle inequality's hyperplane form. Only then y is copied to cell i (i < j, so a
pair meets once). Cells join independently; large ones are cut into blocks of BLOCK vectors, and members and
visitors stream past each block. How many cells a vector reaches depends on the data: clustered vectors
reach few, random directions in 64 dimensions nearly all, and then the join is the full comparison in blocks.

Equal vectors are one class first, with a count. A cell emits link counts and a spanning forest, never pairs.
Candidates come from float32 products with a margin; cosines in double precision decide.

Cases: null vectors, zero vectors, and vectors with null or non-finite components link with nothing and are their own
component; rows without vec_id link with nothing and have no component; vectors of different lengths do not link; repeated rows are vectors of their own with links to
each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, shared_dir, shuffle_width, small_batches, stored, table
from .simhash import forest

LEAST, BLOCK, MAX_PIVOTS, SEED = 0.9, 4096, 512, 42
MARGIN = 1e-4


def classes(vectors: DataFrame, base: str) -> DataFrame:
    """(cid, copies, dim, raw): one row for each distinct usable vector; raw is its float64 bytes; cid the smallest id."""
    usable = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    each = usable.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.asarray(v, dtype="<f8") for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(v) for v in vecs], pa.int32()), pa.array([v.tobytes() for v in vecs], pa.binary())], names=["cid", "copies", "dim", "raw"])

    return stored(each.select(F.col("cid").cast("long"), "copies", "embedding").mapInArrow(pack, "cid long, copies long, dim int, raw binary"), f"{base}/classes")


def unit(raws: list[bytes], dim: int) -> np.ndarray:
    """Rows scaled to length 1, also where squares would overflow or vanish."""
    m = np.frombuffer(b"".join(raws), dtype="<f8").reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def pivots_of(reps: DataFrame) -> dict[int, np.ndarray]:
    """By dimension the unit pivots: one for BLOCK vectors, MAX_PIVOTS at most."""
    found = {}
    for r in reps.groupBy("dim").count().collect():
        n = max(1, min(MAX_PIVOTS, -(-r["count"] // BLOCK)))
        rows = reps.where(F.col("dim") == r.dim).orderBy(F.xxhash64("cid", F.lit(SEED)), "cid").limit(n).select("raw").collect()
        found[r.dim] = unit([bytes(x.raw) for x in rows], r.dim)
    return found


def cells_of(vecs: np.ndarray, pivots: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each vector, and the boolean matrix of lower cells that it visits."""
    d2 = np.maximum(2 - 2 * (vecs @ pivots.T), 0)
    own = d2.argmin(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    far = np.take(gap, own, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = (d2 - d2[np.arange(len(vecs)), own][:, None]) / (2 * far)
    visit = (bound <= chord + 1e-9) | (far < 1e-12)
    return own, visit & (np.arange(len(pivots))[None, :] < own[:, None])


def range_join(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (a, b, n): n > 0 adds n links to class a; n = 0 is an edge of a spanning forest."""
    spark = reps.sparkSession
    small_batches(spark, 2048)
    pivots, chord = pivots_of(reps), float(np.sqrt(2 - 2 * least))
    held = spark.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors a dimension

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, copies, dim = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw = np.array(b.column(3).to_pylist(), dtype=object)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                own, visit = cells_of(unit(list(raw[at]), int(d)), held.value[int(d)], chord)
                i, cell = np.nonzero(visit)
                cols = [np.full(len(at) + len(i), d), np.concatenate((own, cell)), np.concatenate((np.ones(len(at), bool), np.zeros(len(i), bool)))]
                rows = np.concatenate((at, at[i]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cid[rows]), pa.array(copies[rows]), pa.array(list(raw[rows]), pa.binary())], names=["dim", "cell", "native", "cid", "copies", "raw"])

    placed = reps.mapInArrow(assign, "dim int, cell int, native boolean, cid long, copies long, raw binary")
    sizes = placed.where("native").groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(sizes), ["dim", "cell"])  # MAX_PIVOTS rows a dimension
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    index = placed.where("native").withColumn("block", own).withColumn("probe", F.lit(False))
    # A member passes the blocks after its own too, a visitor all blocks.
    first = F.when(F.col("native"), own + 1).otherwise(0)
    probe = placed.withColumn("block", F.explode(F.when(first < F.col("blocks"), F.sequence(first, F.col("blocks") - 1)).otherwise(F.array().cast("array<int>")))).withColumn("probe", F.lit(True))
    cols = ["dim", "cell", "block", "probe", "cid", "copies", "raw"]
    flow = index.select(*cols).unionByName(probe.select(*cols)).repartition(shuffle_width(spark), "dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "probe")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, mine, done = None, [], None
        for b in batches:
            dim, cell, block, probe, cid, copies = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            raw = b.column(6).to_pylist()
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(probe.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(dim)]):
                if lo == hi:
                    continue
                at = (dim[lo], cell[lo], block[lo])
                if at != here:
                    if mine and done is None:
                        yield from inside(*gathered(mine))
                    here, mine, done = at, [], None
                part = (cid[lo:hi], copies[lo:hi], unit(raw[lo:hi], int(dim[lo])))
                if not probe[lo]:
                    mine.append(part)
                    continue
                if done is None and mine:
                    done = gathered(mine)
                    yield from inside(*done)
                if done is not None:
                    yield from between(part, done)
        if mine and done is None:
            yield from inside(*gathered(mine))

    def gathered(parts: list[tuple]) -> tuple:
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))

    def inside(cid: np.ndarray, copies: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(cid), 1024):
            part = (cid[i : i + 1024], copies[i : i + 1024], vecs[i : i + 1024])
            yield from between(part, (cid[i:], copies[i:], vecs[i:]), own=True)

    def between(left: tuple, right: tuple, own: bool = False) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(left[2].astype(np.float32) @ right[2].astype(np.float32).T >= least - MARGIN)
        if own:  # the two start at the same vector: each pair once
            i, j = i[i < j], j[i < j]
        keep = np.einsum("ij,ij->i", left[2][i], right[2][j]) >= least if len(i) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if len(i):
            links_l, links_r = np.zeros(len(left[0]), np.int64), np.zeros(len(right[0]), np.int64)
            np.add.at(links_l, i, right[1][j]), np.add.at(links_r, j, left[1][i])
            l, r = np.flatnonzero(links_l), np.flatnonzero(links_r)
            a, b = forest(left[0][i], right[0][j])
            node = np.concatenate((left[0][l], right[0][r], a))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate((left[0][l], right[0][r], b))), pa.array(np.concatenate((links_l[l], links_r[r], np.zeros(len(a), np.int64))))], names=["a", "b", "n"])

    return flow.mapInArrow(join, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    base = shared_dir(spark)
    reps = classes(vectors, base)
    found = stored(range_join(reps, least), f"{base}/links")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "cid")
    roots = components(found.where("n = 0").select("a", "b")).withColumnsRenamed({"node": "cid", "root": "root"})
    per = reps.select("cid", "copies", "dim").join(counts, "cid", "left").join(roots, "cid", "left")
    per = per.select("cid", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component"))
    # Rows find their class by the vector's value again.
    own = vectors.select("vec_id", "embedding").groupBy("embedding").agg(F.min("vec_id").cast("long").alias("cid"))
    named = own.join(per, "cid").where("embedding IS NOT NULL")
    out = vectors.select("vec_id", "embedding").join(named, "embedding", "left")
    comp = F.coalesce("component", F.col("vec_id").cast("long"))
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
       WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id AS vb FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(r, here, vec_id) AS (SELECT r, r, vec_id FROM v UNION SELECT reach.r, link.b, link.vb FROM reach JOIN link ON link.a = reach.here),
low AS (SELECT r, min(vec_id) AS component_id FROM reach GROUP BY r),
cnt AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links, low.component_id, v.vec_id = low.component_id AS kept FROM v JOIN low USING (r) LEFT JOIN cnt USING (r)
"""
