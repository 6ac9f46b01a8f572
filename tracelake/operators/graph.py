"""Closures over edges (parent_object_id, child_object_id): frontier loops that cut lineage in the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import shared_dir, stored

#: Longest chain of point lookups that lineage_path follows.
MAX_DEPTH = 256


def closure(edges: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    """(node, depth): nodes reachable from start (column node), with the shortest distance; cycles are safe.

    Each round joins the frontier, not the visited set, with the edges and is written to the shared folder.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    src, dst = ("child_object_id", "parent_object_id") if up else ("parent_object_id", "child_object_id")
    step = stored(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")), f"{base}/edges")
    front = stored(start.select("node").distinct().withColumn("depth", F.lit(0)), f"{base}/d0")
    seen = front
    for depth in count(1):
        nxt = front.join(step, "node").select(F.col("to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stored(nxt.withColumn("depth", F.lit(depth)), f"{base}/d{depth}")
        if not front.limit(1).count():
            return seen
        seen = spark.read.schema(front.schema).parquet(*[f"{base}/d{k}" for k in range(depth + 1)])


def max_depth(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the largest of the nodes' shortest distances from any root. Edges to unknown ids are followed too."""
    from .lineage import roots

    far = closure(edges, roots(objects, edges).select(F.col("object_id").alias("node")))
    return far.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))


def ancestor_edges(edges: DataFrame, node: str, shortcuts: bool = True) -> DataFrame:
    """Edges between a node and its ancestors; without shortcuts only those that lead one step nearer."""
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    up = stored(closure(edges, start, up=True), shared_dir(edges.sparkSession))
    child = up.select(F.col("node").alias("child_object_id"), F.col("depth").alias("child_depth"))
    parent = up.select(F.col("node").alias("parent_object_id"), F.col("depth").alias("parent_depth"))
    out = edges.join(child, "child_object_id").join(parent, "parent_object_id")
    return out if shortcuts else out.where("parent_depth > child_depth")


def _trimmed(steps: DataFrame) -> DataFrame:
    """Steps (p, c) left when nodes without incoming or without outgoing ones are taken away until none is left; stored."""
    base = shared_dir(steps.sparkSession)
    cur = stored(steps, f"{base}/0")
    n, k = cur.count(), 0
    while n:
        k += 1
        kept = cur.join(cur.select(F.col("c").alias("p")).distinct(), "p", "left_semi").join(cur.select(F.col("p").alias("c")).distinct(), "c", "left_semi")
        cur = stored(kept.select("p", "c"), f"{base}/{k}")
        left = cur.count()
        if left == n:
            break
        n = left
    return cur


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent_object_id").alias("p"), F.col("child_object_id").alias("c")).distinct()


def cycle_core(edges: DataFrame) -> DataFrame:
    """(node): what is left when nodes without incoming or without outgoing edges are taken away until none is left.

    Empty exactly if there is no cycle; holds every node on a cycle and the nodes on paths between cycles.
    """
    return _trimmed(_steps(edges)).select(F.col("p").alias("node")).distinct()


def _colours(steps: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node of steps (p, c), itself included; stored."""
    base = shared_dir(steps.sparkSession)
    nodes = steps.select(F.col("p").alias("node")).union(steps.select("c")).distinct()
    cur = stored(nodes.select("node", F.col("node").alias("colour")), f"{base}/0")
    for k in count(1):
        sent = steps.join(cur.withColumnRenamed("node", "p"), "p").groupBy(F.col("c").alias("node")).agg(F.min("colour").alias("sent"))
        low = cur.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), F.coalesce(F.expr("sent < colour"), F.lit(False)).alias("moved"))
        nxt = stored(low, f"{base}/{k}")
        cur = nxt.select("node", "colour")
        if not nxt.where("moved").limit(1).count():
            return cur


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves, the strongly connected components of the core.

    Each round colours every node by the smallest one that reaches it; what reaches its colour's node inside the colour is that
    node's component. Rows stay in proportion to edges: pairs of nodes are never listed. Rounds go on with the edges inside a
    colour that touch no component found, until none is left.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    cur, found = _trimmed(_steps(edges)), []
    while cur.limit(1).count():
        k, colours = len(found), _colours(cur)
        of_p, of_c = colours.select(F.col("node").alias("p"), F.col("colour").alias("x")), colours.select(F.col("node").alias("c"), F.col("colour").alias("y"))
        same = stored(cur.join(of_p, "p").join(of_c, "c").where("x = y").select("p", "c"), f"{base}/same{k}")
        inner = same.select(F.col("p").alias("parent_object_id"), F.col("c").alias("child_object_id"))
        done = stored(closure(inner, colours.where("node = colour").select("node"), up=True).select("node"), f"{base}/done{k}")
        as_p, as_c = done.withColumnRenamed("node", "p"), done.withColumnRenamed("node", "c")
        stored(same.join(as_p, "p", "left_semi").join(as_c, "c", "left_semi").select(F.col("p").alias("node")).distinct(), f"{base}/found{k}")
        found.append(f"{base}/found{k}")
        cur = _trimmed(same.join(as_p, "p", "left_anti").join(as_c, "c", "left_anti").select("p", "c"))
    none = cur.select(F.col("p").alias("node"))
    return spark.read.schema(none.schema).parquet(*found) if found else none


def paths(entries: DataFrame, root: int) -> DataFrame:
    """(id, path): full paths of (id, parent, name) below a root; entries that do not reach it get `[orphan]\\name`.

    An id is not entered twice on a path: repeated ids can lie on a cycle below the root."""
    spark = entries.sparkSession
    base = shared_dir(spark)
    e = stored(entries.select("id", "parent", "name"), f"{base}/entries").where(F.col("id") != root)
    front = stored(e.where(F.col("parent") == root).select("id", F.concat(F.lit("\\"), "name").alias("path"), F.array("id").alias("trail")), f"{base}/0")
    k = 0
    while front.limit(1).count():
        k += 1
        below = e.select("id", F.col("parent").alias("up"), "name").join(front.select(F.col("id").alias("up"), "path", "trail"), "up").where(~F.array_contains("trail", F.col("id")))
        front = stored(below.select("id", F.concat("path", F.lit("\\"), "name").alias("path"), F.array_append("trail", F.col("id")).alias("trail")), f"{base}/{k}")
    full = spark.read.schema("id long, path string").parquet(*[f"{base}/{i}" for i in range(k + 1)])
    return e.join(full, "id", "left").select("id", F.coalesce("path", F.concat(F.lit("[orphan]\\"), "name")).alias("path"))


def lineage_path(parents: DataFrame, node: str, max_depth_: int = MAX_DEPTH) -> list[str]:
    """Ids from the root down to a node along one parent pointer (object_id, parent_id); ValueError on a cycle or beyond the depth.

    A path is a chain of at most max_depth_ point lookups.
    """
    out, at = [], node
    while at is not None:
        if at in out:
            raise ValueError(f"cycle at {at}")
        if len(out) > max_depth_:
            raise ValueError(f"deeper than {max_depth_}")
        out.append(at)
        row = parents.where(F.col("object_id") == at).select("parent_id").first()
        at = row[0] if row else None
    return out[::-1]


def tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth, path) of everything below the roots (column node); a node is not entered twice on a path."""
    spark = edges.sparkSession
    base = shared_dir(spark)
    step = stored(edges.select(F.col("parent_object_id").alias("node"), F.col("child_object_id").alias("to")), f"{base}/edges")
    front = stored(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.col("node").alias("path")), f"{base}/0")
    k = 0
    while front.limit(1).count():
        k += 1
        bars = lambda c: F.concat(F.lit("/"), c, F.lit("/"))
        nxt = front.join(step, "node").where(F.instr(bars(F.col("path")), bars(F.col("to"))) == 0)
        front = stored(nxt.select("root", F.col("to").alias("node"), F.lit(k).alias("depth"), F.concat("path", F.lit("/"), "to").alias("path")), f"{base}/{k}")
    return spark.read.schema("root string, node string, depth int, path string").parquet(*[f"{base}/{i}" for i in range(k + 1)])
