"""SHA-256 hash trees: pairs are hashed level by level, an odd last node is paired with itself."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import shared_dir, stored

#: Levels that one task folds at once: 2^HEIGHT leaves a group.
HEIGHT = 12


def fold(hashes: list[bytes], levels: int | None = None) -> bytes:
    """Root over hashes; with levels, after exactly so many levels (a group that is not the only one)."""
    if not hashes:
        raise ValueError("no leaves")
    k = 0
    while (levels is None and len(hashes) > 1) or (levels is not None and k < levels):
        if len(hashes) % 2:
            hashes = [*hashes, hashes[-1]]
        hashes = [hashlib.sha256(a + b).digest() for a, b in zip(hashes[::2], hashes[1::2])]
        k += 1
    return hashes[0]


def _top(levels: int | None):
    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        node = fold([bytes.fromhex(x) for x in pdf["h"]], levels)
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0]) >> HEIGHT], "h": [node.hex()]})

    return top


def root(leaves: DataFrame) -> DataFrame:
    """One row (leaves, root) over (sequence 0.., plaintext_sha256); no row without leaves.

    Groups of 2^HEIGHT neighbours are folded to their top node in parallel, until one group is left.
    """
    spark = leaves.sparkSession
    base = shared_dir(spark)
    cur = stored(leaves.select(F.col("sequence").alias("i"), F.col("plaintext_sha256").alias("h")), f"{base}/0")
    n = total = cur.count()
    level = 0
    while n > 1:
        level += 1
        cur = stored(cur.groupBy(F.shiftright("i", HEIGHT).alias("g")).applyInPandas(_top(None if n <= 1 << HEIGHT else HEIGHT), "i long, h string"), f"{base}/{level}")
        n = (n + (1 << HEIGHT) - 1) >> HEIGHT
    return cur.select(F.lit(total).cast("long").alias("leaves"), F.col("h").alias("root"))


def tree(leaves: DataFrame) -> DataFrame:
    """(level, i, h) of all nodes, leaves at level 0; one aggregate a level."""
    spark = leaves.sparkSession
    base = shared_dir(spark)
    cur = stored(leaves.select(F.lit(0).alias("level"), F.col("sequence").alias("i"), F.col("plaintext_sha256").alias("h")), f"{base}/0")
    n, level = cur.count(), 0
    while n > 1:
        level += 1
        pair = cur.groupBy(F.shiftright("i", 1).alias("j")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        node = F.sha2(F.concat(F.unhex("a"), F.unhex("b")), 256)  # of an odd tail, first and last are the same
        cur = stored(pair.select(F.lit(level).alias("level"), F.col("j").alias("i"), node.alias("h")), f"{base}/{level}")
        n = (n + 1) // 2
    return spark.read.schema("level int, i long, h string").parquet(*[f"{base}/{k}" for k in range(level + 1)])


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """(level, i): inner nodes that are not the hash of the two below, or lack them."""
    below = nodes.groupBy((F.col("level") + 1).alias("level"), F.shiftright("i", 1).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
    top = nodes.where("level > 0").join(below, ["level", "i"], "left")
    right = F.sha2(F.concat(F.unhex("a"), F.unhex("b")), 256)
    return top.where(~F.col("h").eqNullSafe(right)).select("level", "i")


def proof(nodes: DataFrame, leaf: int) -> DataFrame:
    """(level, side, sibling) from a leaf to the root; the sibling of an odd tail is itself, on the right."""
    sizes = nodes.groupBy("level").agg((F.max("i") + 1).alias("n"))
    at = F.expr(f"shiftright({int(leaf)}L, level)")
    want = sizes.where("n > 1").select("level", at.alias("at"), F.least(at.bitwiseXOR(F.lit(1)), F.col("n") - 1).alias("i"))
    side = F.when(F.col("at") % 2 == 1, "left").otherwise("right")
    return want.withColumn("side", side).join(nodes, ["level", "i"]).select("level", "side", F.col("h").alias("sibling"))


def fold_proof(steps: DataFrame, leaf_hash: str) -> DataFrame:
    """One row (root) that a proof leads to; a proof has one step a level."""
    sorted_steps = F.array_sort(F.collect_list(F.struct("level", "side", "sibling")))
    up = lambda acc, s: F.sha2(F.when(s["side"] == "left", F.concat(F.unhex(s["sibling"]), F.unhex(acc))).otherwise(F.concat(F.unhex(acc), F.unhex(s["sibling"]))), 256)
    return steps.agg(F.aggregate(sorted_steps, F.lit(leaf_hash), up).alias("root"))


def blob(levels: list[list[bytes]], magic: bytes) -> bytes:
    """Serialised tree: four magic bytes, version 1, node count (big-endian), nodes by level, root."""
    nodes = [n for level in levels for n in level]
    return magic + b"\x01" + struct.pack(">I", len(nodes)) + b"".join(nodes) + levels[-1][0]


def levels_of(hashes: list[bytes]) -> Iterator[list[bytes]]:
    level = list(hashes)
    yield level
    while len(level) > 1:
        if len(level) % 2:
            level = [*level, level[-1]]
        level = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
        yield level


def check_blob(data: bytes, magic: bytes, leaf_count: int) -> list[str]:
    """What is wrong with a serialised tree: magic, version, length, node, root."""
    if data[:4] != magic or len(data) < 9 + 32:
        return ["magic"]
    if data[4] != 1:
        return ["version"]
    sizes = [leaf_count]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    if struct.unpack(">I", data[5:9])[0] != sum(sizes) or len(data) != 9 + 32 * (sum(sizes) + 1):
        return ["length"]
    at, levels = 9, []
    for n in sizes:
        levels.append([data[at + 32 * k : at + 32 * k + 32] for k in range(n)])
        at += 32 * n
    bad = [f"node {k + 1}/{i}" for k, (low, high) in enumerate(zip(levels, levels[1:])) for i, h in enumerate(high) if h != hashlib.sha256(low[2 * i] + low[min(2 * i + 1, len(low) - 1)]).digest()]
    return bad + (["root"] if data[-32:] != levels[-1][0] else [])
